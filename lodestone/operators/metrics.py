"""Training metrics as tables: means, windows, schedules, and a recorder for the driver."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def means(values: DataFrame) -> DataFrame:
    """``dataset, mean, n`` of ``dataset, value`` rows."""
    return values.groupBy("dataset").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def windowed(losses: DataFrame, steps: int) -> DataFrame:
    """``step, loss``: the mean loss of each run of ``steps`` accumulation steps (``step, loss``)."""
    return losses.groupBy(F.floor(F.col("step") / steps).alias("step")).agg(F.avg("loss").alias("loss"))


def warmup_stable_decay(step: Column, warm: int, decay_from: int, total: int) -> Column:
    """The share of the top rate at a step: up to 1 over ``warm`` steps, 1, then down to 0 from ``decay_from`` to ``total``."""
    s = step.cast("double")
    return F.when(s < warm, s / warm).when(s < decay_from, 1.0).otherwise(F.greatest(F.lit(0.0), (total - s) / (total - decay_from)))


def every(step: Column, n: int) -> Column:
    """Whether the step ends a run of ``n``."""
    return (step + 1) % n == 0


def stop_early(step: int, horizon: int | None = None, limit: int | None = None, stopped: bool = False) -> str | None:
    """Why to stop after ``step`` steps: the horizon, a limit of iterations, a request from outside; None to go on."""
    if stopped:
        return "asked to stop"
    if limit is not None and step >= limit:
        return f"limit of {limit} iterations"
    return f"horizon of {horizon} steps" if horizon is not None and step >= horizon else None


class Recorder:
    """Values recorded at most once between two reports, and timers; a report is a line of sorted JSON and empties the recorder."""

    def __init__(self):
        self.values: dict[str, float] = {}

    def record(self, name: str, value: float) -> None:
        if name in self.values:
            raise KeyError(f"{name} is already recorded")
        self.values[name] = value

    @contextmanager
    def timed(self, name: str):
        began = time.monotonic()
        yield
        self.record(name, time.monotonic() - began)

    def report(self) -> str:
        line = json.dumps(self.values, sort_keys=True)
        self.values = {}
        return line


class Stages:
    """Counts of the stages of a plan, taken by Spark as the rows pass, without a scan of their own."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, **sums: str) -> DataFrame:
        """``df``, whose rows and sums of columns are noted under ``name`` when it first runs to its end."""
        if name in self.seen:
            raise KeyError(f"{name} is already watched")
        self.seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])

    def of(self, name: str) -> dict:
        """What was noted of a stage; waits for it to have run."""
        return dict(self.seen[name].get)

    def report(self) -> dict[str, dict]:
        """What was noted of all stages, and as ``dropped`` the rows of the stage before that a stage no longer has."""
        out, before = {}, None
        for name in self.seen:
            out[name] = self.of(name)
            if before is not None:
                out[name]["dropped"] = before - out[name]["rows"]
            before = out[name]["rows"]
        return out
