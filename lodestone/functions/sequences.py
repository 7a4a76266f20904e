"""Arrays of token ids and logits: collation, masks, label shifts, answers, log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.messages import pad

IGNORE = -100


def collate(ids: Column, longest: Column, limit: int, value: int, left: bool = False) -> Column:
    """Truncated to ``limit`` and padded to the batch's longest, itself cut at ``limit``."""
    return pad(F.slice(ids, 1, limit), F.least(longest, F.lit(limit)), value, left)


def attention_mask(length: Column, size: Column) -> Column:
    """Ones for tokens, zeros for padding on the right."""
    return F.concat(F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), F.greatest(size - length, F.lit(0))))


def answer_labels(prompt: Column, answer: Column) -> Column:
    """Labels of prompt and answer: the prompt ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer)


def shifted(labels: Column, keep_length: bool = False) -> Column:
    """Labels moved left by one; ``keep_length`` ends them with an ignored place."""
    rest = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.concat(rest, F.array(F.lit(IGNORE))) if keep_length else rest


def prompts_agree(a: Column, b: Column) -> Column:
    """Whether two tokenised prompts differ in at most one token and by at most one in length."""
    n = F.least(F.size(a), F.size(b))
    unequal = F.size(F.filter(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), lambda d: d))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (unequal <= 1)


def aligned(value: Column, a: Column, b: Column) -> Column:
    """``value``, or an error where the prompts do not agree."""
    return F.when(prompts_agree(a, b), value).otherwise(F.raise_error(F.lit("chosen and rejected prompts differ")))


def label_log_prob(logits: Column, label: Column) -> Column:
    """The log-softmax of ``logits`` at the 0-based ``label``; null for an ignored label."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.when(label != IGNORE, F.get(logits, label).cast("double") - top - F.log(total))


def first_given(*ids: Column) -> Column:
    """The first non-null of the given token lists; an error if there is none."""
    return F.coalesce(*ids, F.raise_error(F.lit("no output tokens")))
