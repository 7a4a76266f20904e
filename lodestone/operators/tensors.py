"""Model arithmetic as dataflow: truncated losses, block gating, expert slots, operation counts, hashed embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import dot, unit
from lodestone.operators.position import with_position
from lodestone.operators.retrieval import info_nce


def cosine_scores(pairs: DataFrame, dimension: int | None = None) -> DataFrame:
    """Add ``score``: the cosine of ``query_vector`` and ``document_vector``, of their first ``dimension`` components if given."""
    cut = lambda c: F.slice(c, 1, dimension) if dimension else F.col(c)
    return pairs.withColumn("score", dot(unit(cut("query_vector")), unit(cut("document_vector"))))


def truncated_info_nce(pairs: DataFrame, dimension: int, weight: float = 0.5, temperature: float = 0.01) -> DataFrame:
    """``query_id, document_id, loss, full, truncated``: the contrastive loss of whole vectors and of their first components, weighed together."""
    if not 0 < weight < 1:
        raise ValueError("the weight lies between 0 and 1")
    full = info_nce(cosine_scores(pairs), temperature).withColumnRenamed("loss", "full")
    part = info_nce(cosine_scores(pairs, dimension), temperature).withColumnRenamed("loss", "truncated")
    return full.join(part, ["query_id", "document_id"]).withColumn("loss", (1 - weight) * F.col("full") + weight * F.col("truncated"))


def pooled(tokens: DataFrame) -> DataFrame:
    """``seq, mean, first, last``: token vectors (``seq, pos, mask, vector``) under the mask, averaged, and those of the first and the last token."""
    held = tokens.filter("mask")
    each = held.select("seq", F.posexplode("vector").alias("i", "x")).groupBy("seq", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = each.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
    ends = held.groupBy("seq").agg(F.min_by("vector", "pos").alias("first"), F.max_by("vector", "pos").alias("last"))
    return means.join(ends, "seq")


def preference_loss(chosen: Column, rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float = 0.1, smoothing: float = 0.0) -> dict[str, Column]:
    """``loss, chosen_reward, rejected_reward`` from the summed log probabilities of both answers under the model and the reference.

    With ``smoothing`` the labels count as swapped with that probability.
    """
    good, bad = beta * (chosen - reference_chosen), beta * (rejected - reference_rejected)
    gap = good - bad
    loss = (1 - smoothing) * F.log1p(F.exp(-gap)) + smoothing * F.log1p(F.exp(gap))
    return {"loss": loss, "chosen_reward": good, "rejected_reward": bad}


def block_gates(tokens: DataFrame, size: int, k: int) -> DataFrame:
    """The key blocks that each token attends to: ``seq, pos, block``.

    ``tokens`` holds ``seq, pos, q, k``.  A token takes its own block, and of the blocks before it the
    ``k`` - 1 whose mean key has the greatest dot product with its query, the earlier block first on ties.
    """
    rows = tokens.withColumn("own", F.floor(F.col("pos") / size))
    each = rows.select("seq", F.col("own").alias("block"), F.posexplode("k").alias("i", "x"))
    means = each.groupBy("seq", "block", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    keys = means.groupBy("seq", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("mean"))
    past = rows.join(keys, "seq").filter("block < own").select("seq", "pos", "block", dot(F.col("q"), F.col("mean")).alias("gate"))
    best = Window.partitionBy("seq", "pos").orderBy(F.round("gate", 9).desc(), "block")
    chosen = past.withColumn("r", F.row_number().over(best)).filter(F.col("r") < k).select("seq", "pos", "block")
    return chosen.unionByName(rows.select("seq", "pos", F.col("own").alias("block")))


def expert_slots(routed: DataFrame, experts: int = 10_000) -> DataFrame:
    """Add ``slot``: a token's place among its expert's tokens, by one range partitioning of (expert, token) and each expert's first place."""
    placed = with_position(routed, "expert", "token")
    starts = placed.groupBy("expert").agg(F.min("pos").alias("__s"))
    if starts.count() > experts:
        raise ValueError(f"more than {experts} experts")
    return placed.join(F.broadcast(starts), "expert").withColumn("slot", F.col("pos") - F.col("__s")).drop("pos", "__s")


def training_tera_ops(lengths: Column, layers: int, hidden: int, parameters: int, checkpointing: bool = False, forward_only: bool = False) -> Column:
    """10^12 operations of a dense decoder over packed sample lengths."""
    dense, attention = (2, 2) if forward_only else (8, 16) if checkpointing else (6, 12)
    one = lambda n: dense * float(parameters) * n + attention * float(layers * hidden) * n * n
    return F.aggregate(lengths, F.lit(0.0), lambda s, n: s + one(n.cast("double"))) / 1e12


def decoder_parameters(hidden: int, vocabulary: int, layers: int, heads: int, key_heads: int, intermediate: int, head: int | None = None) -> tuple[int, int]:
    """Weights that take part per token in a gated decoder, and its attention width (the ``hidden`` of the count)."""
    head = head or hidden // heads
    projections = hidden * head * (2 * heads + 2 * key_heads)
    return (3 * hidden * intermediate + projections) * layers + vocabulary * hidden, heads * head


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A deterministic embedding without a model: signed counts of hashed tokens, normalised; nulls for no tokens."""
    places = F.transform(tokens, lambda t: F.xxhash64(t))
    signed = lambda i: F.size(F.filter(places, lambda h: F.pmod(h, F.lit(2 * dimension)) == 2 * i)) - F.size(F.filter(places, lambda h: F.pmod(h, F.lit(2 * dimension)) == 2 * i + 1))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), signed))
