"""Chat messages: extraction by role, templates, prefixes, label masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
THINK = re.compile(r"^<think>\s*</think>\s*")


def gather(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``messages: array<struct<role, content>>`` per conversation, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(by).agg(F.transform(listed, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def contents_of(messages: Column, role: str) -> Column:
    """Non-empty contents of one role, in order."""
    return F.transform(F.filter(messages, lambda m: (m["role"] == role) & m["content"].isNotNull() & (m["content"] != "")), lambda m: m["content"])


def role_zip(messages: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """Rounds of one message per role, cut to the role with the fewest messages; roles without any are left out."""
    lists = {r: contents_of(messages, r) for r in roles}
    rounds = F.array_min(F.filter(F.array(*[F.size(x) for x in lists.values()]), lambda n: n > 0))

    def one(i: Column) -> Column:
        parts = F.array(*[F.struct(F.lit(r).alias("role"), F.get(x, i).alias("content")) for r, x in lists.items()])
        return F.filter(parts, lambda m: m["content"].isNotNull())

    return F.when(rounds.isNull(), F.array().cast("array<struct<role:string,content:string>>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), one)))


def first_content(item: Column, fields: tuple[str, ...], key: str | None = None) -> Column:
    """The content of a free-form message: the named field, else the first non-null of content, text, message, value."""
    names = [key] if key else [f for f in ("content", "text", "message", "value") if f in fields]
    return F.coalesce(*[item[n] for n in names]).cast("string")


def first_and_last(messages: Column) -> Column:
    """Only the first and the last message."""
    return F.array(F.element_at(messages, 1), F.element_at(messages, -1))


def common_prefix(a: Column, b: Column, compat: bool = False) -> Column:
    """Number of leading messages with equal content; ``compat`` is one short when no message differs."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a, i)["content"].eqNullSafe(F.get(b, i)["content"]))
    return F.when(n < 1, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)), n - 1 if compat else n)).cast("int")


def chat_text(messages: Column) -> Column:
    """A plain chat template."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def strip_empty_think(text: Column) -> Column:
    """Without an empty reasoning block at the start."""
    return F.regexp_replace(text, THINK.pattern, "")


def find_content(text: Column, content: Column) -> Column:
    """0-based place of the content's first occurrence, -1 if absent."""
    return F.instr(text, content) - 1


def mask_labels(ids: Column, inside: Column, ignore: int = -100) -> Column:
    """Labels: tokens whose flag is set, and one token after each run of flags; others are ignored."""
    return F.transform(ids, lambda t, i: F.when(F.get(inside, i) | F.coalesce(F.get(inside, i - 1), F.lit(False)), t).otherwise(F.lit(ignore)))


def with_bos(ids: Column, bos: int) -> Column:
    """BOS in front unless it is there."""
    return F.when(F.get(ids, F.lit(0)) == bos, ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def with_eos(ids: Column, eos: int) -> Column:
    """EOS at the end; if the last but one is EOS, the last goes instead."""
    n = F.size(ids)
    return F.when(F.get(ids, n - 2) == eos, F.slice(ids, 1, F.greatest(n - 1, F.lit(0)))).when(F.get(ids, n - 1) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def pad(ids: Column, size: Column, value: int, left: bool = False) -> Column:
    """Padded to ``size``."""
    fill = F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pair_truncation(prompt: Column, chosen: Column, rejected: Column, max_length: int, max_prompt: int, keep_end: bool = False) -> tuple[Column, Column, Column]:
    """Truncate the prompt first where prompt and the longer answer exceed ``max_length``, then the answers."""
    longest = F.greatest(F.size(chosen), F.size(rejected))
    over = F.size(prompt) + longest > max_length
    n = F.least(F.size(prompt), F.lit(max_prompt))
    part = F.slice(prompt, F.size(prompt) - n + 1, n) if keep_end else F.slice(prompt, 1, n)
    cut = F.when(over, part).otherwise(prompt)
    still = F.size(cut) + longest > max_length
    answer = lambda a: F.when(still, F.slice(a, 1, max_length - max_prompt)).otherwise(a)
    return cut, answer(chosen), answer(rejected)


def boundary(prompt: Column, whole: Column) -> Column:
    """Length of the prompt's part of a jointly tokenised text: one less if the boundary token merged."""
    n = F.size(prompt)
    return F.when(F.slice(whole, 1, n) == prompt, n).otherwise(n - 1)
