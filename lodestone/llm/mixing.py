"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative target shares, so every stretch of slots holds
each source in proportion; slots are ranked per source, and the r-th slot of a source takes the r-th
equal-token block of that source's shuffled documents, which repeat from the start once used up.  Points are
64-bit integers that wrap, so they are exact at any slot, and the number of earlier points below an edge
has a closed form (``points_below``), so chunks of slots are dealt and ranked without a shuffle.

A target stops at ``max_repeats`` times its source's size; the excess goes to the other sources by
weight.  Null text has no words; documents without words are in no block.  A null source is a source of
its own.  Rows that agree in id, text and source are interchangeable, so reruns agree.  Sources are a
configuration-sized set: their sums are held on the driver and broadcast, and more than ``MAX_SOURCES``
(a table of a few MB) is an error.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.text import word_count
from lodestone.plans.running import order_hash, running_sum
from lodestone.plans.scratch import materialise

MAX_SOURCES = 100_000
BLOCK_TOKENS = 512
SLOTS_PER_CHUNK = 4096
#: The golden ratio's fraction in units of 2 to the -64, and odd, so that no point repeats.
GOLDEN, TURN = 0x9E3779B97F4A7C15, 1 << 64


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left / weight * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left / weight * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a i + b) // m over i below n, by the Euclidean steps of a and m."""
    total = 0
    while n > 0:
        total += (n - 1) * n // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        n, b, a, m = top // m, top % m, m, a
    return total


def points_below(n: int, edge: int) -> int:
    """How many of the first ``n`` points of the sequence lie below ``edge``."""
    return n + _floor_sum(n, TURN, GOLDEN, 0) - _floor_sum(n, TURN, GOLDEN, TURN - edge)


class Mix:
    """The measured rows, the source table and the schedule of one mix.

    ``weights`` repeat over the sources in code-point order, null last.
    """

    def __init__(self, docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: float = 2.0, block_tokens: int = BLOCK_TOKENS, seed: int = 42):
        self.spark, self.block_tokens = docs.sparkSession, block_tokens
        self.seed = seed
        rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), self.key().alias("key"))
        sized = materialise(rows, "mix-rows")
        found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; weights are set for a named few")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        self.names, self.sizes = [r.source for r in found], [int(r.n) for r in found]
        self.goals = targets(self.sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(self.sizes), max_repeats)
        self.tokens = [min(int(g), int(max_repeats * s)) for g, s in zip(self.goals, self.sizes, strict=True)]
        schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("skey", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("tokens", T.LongType())])
        table = self.spark.createDataFrame([(n, i, s, g, t) for i, (n, s, g, t) in enumerate(zip(self.names, self.sizes, self.goals, self.tokens, strict=True))], schema)
        joined = sized.withColumn("sname", F.col("source")).drop("source").join(F.broadcast(table), F.col("sname").eqNullSafe(F.col("source"))).drop("sname")
        self.rows = joined

    def key(self):
        """The shuffle key of a document within its source."""
        return order_hash(F.lit(self.seed), F.col("doc_id"), F.md5("text"))

    def offsets(self) -> DataFrame:
        """The rows that have words, with ``start``: their first word's place in the shuffled source."""
        return running_sum(self.rows.filter("size > 0"), ["skey"], "key", ["doc_id", "size"], "size", "start")

    def edges(self) -> list[int]:
        """The upper edge of each source's stretch of points; the last is a whole turn."""
        total, upto, out = max(1, sum(self.tokens)), 0, []
        for t in self.tokens:
            upto += t
            out.append(upto * TURN // total)
        return out

    def slot_counts(self) -> tuple[int, list[int]]:
        """The number of scheduled slots, and that of each source, with one more at the end for each that has tokens."""
        slots = ceil(sum(self.tokens) / self.block_tokens)
        below = [points_below(slots, e) for e in self.edges()]
        return slots, [b - a + (t > 0) for a, b, t in zip([0, *below], below, self.tokens, strict=False)]

    def schedule(self) -> DataFrame:
        """``slot, skey, rank`` for every slot; map-only."""
        slots, counts = self.slot_counts()
        edges = self.edges()
        live = np.array([i for i, t in enumerate(self.tokens) if t > 0], dtype=np.int64)
        upper = np.array([edges[i] - 1 for i in live], dtype=np.uint64)  # the last point of each stretch, as a whole turn does not fit

        def deal(batches):
            for b in batches:
                for chunk in b["id"].tolist():
                    first, last = chunk * SLOTS_PER_CHUNK, min(slots, (chunk + 1) * SLOTS_PER_CHUNK)
                    slot = np.arange(first, last, dtype=np.uint64)
                    skey = live[np.searchsorted(upper, slot * np.uint64(GOLDEN), side="left")]
                    order = np.argsort(skey, kind="stable")
                    own, starts, times = np.unique(skey[order], return_index=True, return_counts=True)
                    base = [points_below(first, edges[i]) - (points_below(first, edges[i - 1]) if i else 0) for i in own.tolist()]
                    rank = np.empty(len(slot), dtype=np.int64)
                    rank[order] = np.arange(len(slot)) - np.repeat(starts, times) + np.repeat(np.array(base, dtype=np.int64), times)
                    yield pd.DataFrame({"slot": slot.astype(np.int64), "skey": skey.astype(np.int32), "rank": rank})

        chunks = -(-slots // SLOTS_PER_CHUNK)
        points = self.spark.range(0, chunks, 1, max(1, min(chunks // 16 + 1, 100_000))).mapInPandas(deal, "slot long, skey int, rank long")
        # one more slot at the end for each source that has tokens, so that the smallest is never missed
        small = [i for i, t in enumerate(self.tokens) if t > 0]
        extra = self.spark.createDataFrame([(slots + k, i, counts[i] - 1) for k, i in enumerate(small)], "slot long, skey int, rank long")
        return points.unionByName(extra)

    def spans(self) -> DataFrame:
        """The mix: ``slot, skey, key, doc_id, size, start, epoch, first, last``: words first to last-1 of the document, in slot order."""
        counts = self.slot_counts()[1]
        blocks = self.spark.createDataFrame([(i, c, t // c, t % c) for i, (t, c) in enumerate(zip(self.tokens, counts, strict=True)) if c], "skey int, k long, q long, rem long")
        placed = self.offsets().join(F.broadcast(blocks), "skey")
        copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("source_size")).cast("int") - 1))))
        copies = copies.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).filter("a < tokens").withColumn("z", F.least(F.col("a") + F.col("size"), F.col("tokens")))
        # the first rem blocks hold q + 1 words, the others q
        block = lambda p: F.expr(f"CASE WHEN {p} < rem * (q + 1) THEN ({p}) DIV (q + 1) ELSE rem + ({p} - rem * (q + 1)) DIV greatest(q, 1L) END")
        cut = copies.withColumn("rank", F.explode(F.sequence(block("a"), block("z - 1"))))
        low = F.expr("rank * q + least(rank, rem)")
        high = F.expr("(rank + 1) * q + least(rank + 1, rem)")
        cut = cut.select("skey", "rank", "key", "doc_id", "size", "source_size", "target", "start", "epoch", (F.greatest("a", low) - F.col("a")).alias("first"), (F.least("z", high) - F.col("a")).alias("last"))
        return cut.join(self.schedule(), ["skey", "rank"])

    def taken(self) -> DataFrame:
        """Every input row with ``source_size, target, taken`` and ``first_slot`` (null if the mix takes none of it)."""
        used = self.spans().groupBy("skey", "start", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
        # rows with words that no slot reached, and rows without words
        names = ["doc_id", "size", "source_size", "target"]
        nothing = [F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")]
        all_rows = self.offsets().select("skey", "start", *names, *nothing)
        rest = self.rows.filter("size = 0").select(*names, *nothing)
        found = used.select("skey", "start", *names, "taken", "first_slot").unionByName(all_rows)
        whole = found.groupBy("skey", "start", *names).agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
        return whole.select(*names, "taken", "first_slot").unionByName(rest)

    def source_key(self, docs: DataFrame, source: str) -> DataFrame:
        """``docs`` with the number of its source as ``skey``."""
        table = self.spark.createDataFrame([(n, i) for i, n in enumerate(self.names)], "of string, skey int")
        return docs.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("of"))).drop("of")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the schedule takes them, whole and in slot order: one row for every pass that reaches a document.

    A document stands at the first slot that holds a word of it.  The slots are planned over narrow rows; texts are
    shuffled to their slots and once more into order.  Rows that agree in id, text and source
    are numbered and take the places of that many.  Documents without words are not in the mix.
    """
    mix = Mix(docs.select("doc_id", "source", "text"), **options)
    names = docs.columns
    hidden = [f"c{i}" for i in range(len(names))]
    bare = docs.toDF(*hidden)
    key, source, text = (hidden[names.index(n)] for n in ("doc_id", "source", "text"))
    same = ["skey", "key", "id"]
    places = materialise(mix.spans().groupBy("skey", "key", F.col("doc_id").alias("id"), "start", "epoch").agg(F.min("slot").alias("slot")), "mix-places")
    keyed = mix.source_key(bare.withColumn("key", order_hash(F.lit(mix.seed), F.col(key), F.md5(text))), source).filter(word_count(F.col(text)) > 0).withColumn("id", F.col(key))
    if not mix.rows.filter("size > 0").groupBy("skey", "key", "doc_id").count().filter("count > 1").isEmpty():
        keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
        places = places.withColumn("nth", F.dense_rank().over(Window.partitionBy(*same).orderBy("start")))
        same = [*same, "nth"]
    pairs = [keyed[c].eqNullSafe(places[c]) if c == "id" else keyed[c] == places[c] for c in same]
    mixed = keyed.join(places.hint("shuffle_hash"), reduce(and_, pairs))
    return mixed.orderBy("slot", "start", "epoch").select(*hidden).toDF(*names)
