"""Callbacks before and after the named steps of sources and factories, and checks of what plugins define."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

EVENTS = ("load", "process", "split")


class Hooked:
    """Steps that run between callbacks.

    A class lists ``callbacks`` as ``("pre-load", f)``, where ``f`` is a function of the object and the step's arguments, the name of
    a method of the step's arguments, or a list of these.  Those of base classes come first, each class's in their own order.  A callback before
    a step may return new arguments (a tuple, or the one), one after it a new result; None leaves things as they are.
    """

    callbacks: tuple | list = ()

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        for event, what in vars(cls).get("callbacks", ()):
            when, _, step = event.partition("-")
            if when not in ("pre", "post") or step not in EVENTS:
                raise ValueError(f"no event {event!r}; events are pre- and post- of {', '.join(EVENTS)}")
            for f in what if isinstance(what, (list, tuple)) else [what]:
                if isinstance(f, str) and not callable(getattr(cls, f, None)):
                    raise AttributeError(f"{cls.__name__} has no method {f!r} for {event}")

    def _callbacks(self, event: str) -> Iterator[Callable]:
        for cls in reversed(type(self).__mro__):
            for when, what in vars(cls).get("callbacks", ()):
                if when == event:
                    for f in what if isinstance(what, (list, tuple)) else [what]:
                        yield getattr(self, f) if isinstance(f, str) else lambda *args, f=f: f(self, *args)

    def step(self, event: str, action: Callable, *args):
        """``action`` of the arguments, between the event's callbacks."""
        for f in self._callbacks(f"pre-{event}"):
            changed = f(*args)
            if changed is not None:
                args = changed if isinstance(changed, tuple) else (changed,)
        result = action(*args)
        for f in self._callbacks(f"post-{event}"):
            changed = f(result)
            result = result if changed is None else changed
        return result


def registered(registry: dict, cls: type, kind: str, methods: dict[str, tuple[str, ...]]) -> None:
    """Add a class to a registry under its ``name``: the name must be new, and each method must take the named arguments."""
    if cls.name in registry:
        raise ValueError(f"a {kind} named {cls.name!r} exists")
    for method, wanted in methods.items():
        found = getattr(cls, method, None)
        if not callable(found):
            raise TypeError(f"{cls.__name__} defines no {method}({', '.join(wanted)})")
        names = [p.name for p in inspect.signature(found).parameters.values() if p.name != "self" and p.default is p.empty]
        if tuple(names) != wanted:
            raise TypeError(f"{cls.__name__}.{method} takes ({', '.join(names)}), not ({', '.join(wanted)})")
    registry[cls.name] = cls


def named(registry: dict, name, kind: str) -> type:
    """The registered class of a name; the error lists what there is."""
    if name not in registry:
        raise KeyError(f"no {kind} named {name!r}; there are {', '.join(sorted(map(str, registry)))}")
    return registry[name]
