"""Packing of token sequences.

Both packers take ``chunk, pos, length``; ``chunk`` bounds what is packed together, as each worker of a
sequential packer would have had its own rows.  A chunk may be the whole table: it is cut into blocks of positions, and only a
few numbers a block are carried from one to the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.position import running_total
from lodestone.plans.running import HASH_BITS, order_hash
from lodestone.plans.scratch import materialise

#: Positions of a chunk that one task packs.
BLOCK_ROWS = 1 << 20


def _starts(length: np.ndarray, limit: int, always: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per row the row that starts the next pack if this one starts a pack (their number if none does), and prefix sums with the total.

    A pack ends before the first row that would take it over the limit, or with ``always`` before the first row after it is over.
    """
    upto = np.concatenate([[0], np.cumsum(length)])
    reach = upto[:-1] + limit
    after = np.searchsorted(upto[:-1] if always else upto[1:], reach, "right")
    return np.maximum(after, np.arange(1, len(length) + 1)), upto


def _passage(length: np.ndarray, limit: int, always: bool) -> list[tuple[int, int, int]]:
    """What a block makes of a pack that is open when it begins: steps ``(room, packs, used)``, least room first.

    The room of the open pack is the limit less its tokens.  The first step whose room is not below it tells how many packs
    begin in the block, and how many tokens the last of them holds; a pack with more room than all steps is open to the end.
    There are at most ``limit + 2`` steps.  Rows that begin packs are followed by pointer doubling.
    """
    after, upto = _starts(length, limit, always)
    n = len(length)
    last, count, jump = np.arange(n), np.ones(n, dtype=np.int64), after
    while (jump < n).any():
        inside = np.flatnonzero(jump < n)
        to = jump[inside]
        last[inside], count[inside], jump[inside] = last[to], count[inside] + count[to], jump[to]
    edge = upto[:-1] if always else upto[1:]  # a pack with this room or more is open beyond the row
    # a pack closes at the first row whose edge is above its room, so only the first row of each edge can be that row
    first = np.flatnonzero(np.concatenate([[True], edge[1:] > edge[:-1]]))
    first = first[: np.searchsorted(edge[first], limit, "right") + 1]
    return [(int(edge[i]) - 1, int(count[i]), int(upto[-1] - upto[last[i]])) for i in first]


def _carry(batches, limit: int):
    """State at the beginning of each block from the passages of a chunk's blocks, in order: ``chunk, block, packs, used``."""
    chunk, state = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                chunk, state = r["chunk"], None
            yield chunk, r["block"], state
            packs, used = state or (0, None)
            steps = zip(r["room"], r["packs"], r["used"], strict=True)
            step = next(steps) if used is None else next((s for s in steps if limit - used <= s[0]), None)
            state = (packs, used + r["total"]) if step is None else (packs + step[1], step[2])


def next_fit(df: DataFrame, limit: int, always_max_length: bool = False, drop_last: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``pack``: rows in order; a pack is closed when it exceeds the limit, or (by default) when the next row would.

    With ``always_max_length`` a pack may exceed the limit by up to one row.  ``drop_last`` drops the
    last pack of each chunk.  Pack starts are found by binary search in prefix sums.  Rows are dealt by chunk and block of
    ``block_rows`` positions and stream through as Arrow batches; a chunk of several blocks is first passed over with its lengths alone, which
    gives for each block what it makes of a pack that is open at its beginning.  ``df`` is read up to three times (lengths alone but for the
    last), so it should come from a written table.
    """
    names = df.columns
    plain = [n if n in ("chunk", "pos", "length") else f"c{i}" for i, n in enumerate(names)]
    rows = df.toDF(*plain).withColumn("block", F.floor(F.col("pos") / block_rows))
    spans = rows.groupBy("chunk").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
    state = "packs_before long, used_before long"
    if spans.isEmpty():
        dealt = rows.withColumns({n.split()[0]: F.lit(None).cast("long") for n in state.split(", ")})
    else:
        states = _block_states(rows.select("chunk", "block", "pos", "length").join(spans.select("chunk"), "chunk", "left_semi"), limit, always_max_length)
        dealt = rows.join(states, ["chunk", "block"], "left")

    def run(batches):
        key, pack, used = None, -1, None
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            chunk, block = batch.column("chunk").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            packs = np.zeros(len(length), dtype=np.int32)
            turns = np.flatnonzero((chunk[1:] != chunk[:-1]) | (block[1:] != block[:-1])) + 1
            for a, z in zip([0, *turns], [*turns, len(length)], strict=True):
                if a == z:
                    continue
                if key != (chunk[a], block[a]):
                    key = (chunk[a], block[a])
                    before, held = batch.column("packs_before")[a].as_py(), batch.column("used_before")[a].as_py()
                    pack, used = (-1, None) if held is None else (before - 1, held)
                own = length[a:z]
                after, upto = _starts(own, limit, always_max_length)
                # the rows that the open pack still takes, then pack by pack
                at = 0 if used is None else int(np.searchsorted(upto[:-1] if always_max_length else upto[1:], limit - used, "right"))
                marks, n = [], z - a
                while at < n:
                    marks.append(at)
                    at = int(after[at])
                started = np.zeros(n, dtype=np.int32)
                started[marks] = 1
                packs[a:z] = pack + np.cumsum(started)
                pack += len(marks)
                used = int(upto[-1] - upto[marks[-1]]) if marks else used + int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.select(plain).columns, pa.array(packs)], names=[*plain, "pack"])

    dealt = dealt.repartition("chunk", "block").sortWithinPartitions("chunk", "block", "pos")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in plain], T.StructField("pack", T.IntegerType())])
    packed = dealt.mapInArrow(run, schema)
    if drop_last:
        packed = materialise(packed, "packed")
        ends = packed.groupBy("chunk").agg(F.max("pack").alias("last"))
        packed = packed.join(ends, "chunk").filter("pack < last").select(*plain, "pack")
    return packed.toDF(*names, "pack")


def _block_states(rows: DataFrame, limit: int, always: bool) -> DataFrame:
    """``chunk, block, packs_before, used_before`` of the blocks (but a chunk's first): number and tokens of the pack that is open where the block begins."""
    passage = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("room", pa.list_(pa.int64())), ("packs", pa.list_(pa.int64())), ("used", pa.list_(pa.int64())), ("total", pa.int64())])
    kind = "chunk long, block long, room array<long>, packs array<long>, used array<long>, total long"

    def pass_over(batches):
        key, held = None, []

        def result():
            length = np.concatenate(held)
            steps = _passage(length, limit, always)
            row = {"chunk": key[0], "block": key[1], "total": int(length.sum())} | {n: [s[i] for s in steps] for i, n in enumerate(("room", "packs", "used"))}
            return pa.RecordBatch.from_pylist([row], schema=passage)

        for batch in batches:
            chunk, block, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "block", "length"))
            turns = np.flatnonzero((chunk[1:] != chunk[:-1]) | (block[1:] != block[:-1])) + 1
            for a, z in zip([0, *turns], [*turns, len(length)], strict=True):
                if a == z:
                    continue
                if key != (chunk[a], block[a]):
                    if key is not None:
                        yield result()
                    key, held = (chunk[a], block[a]), []
                held.append(length[a:z].astype(np.int64))
        if key is not None:
            yield result()

    def carry(batches):
        for chunk, block, state in _carry(batches, limit):
            if state is not None:
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "block": [block], "packs_before": [state[0]], "used_before": [state[1]]})

    dealt = rows.repartition("chunk", "block").sortWithinPartitions("chunk", "block", "pos").select("chunk", "block", "length")
    passages = materialise(dealt.mapInArrow(pass_over, kind), "passages")
    in_order = passages.repartition("chunk").sortWithinPartitions("chunk", "block")
    return materialise(in_order.mapInArrow(carry, "chunk long, block long, packs_before long, used_before long"), "block-states")


def fused_positions(positions: Column, key: Column, share: float, seed: int = 42) -> Column:
    """Position ids of a pack that restart for each sample, or, for about ``share`` of the packs by their ``key``, run through."""
    draw = order_hash(F.lit(seed), key) / float(1 << HASH_BITS)
    whole = F.transform(positions, lambda x, i: i)
    return F.when(draw < share, whole).otherwise(positions)


def slice_and_pack(df: DataFrame, limit: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces of rows in packs of exactly ``limit`` tokens: ``chunk, pos, kind, pack, first, n``.

    Rows give their full slices alone (kind ``full``); the tails form one stream that is cut every
    ``limit`` tokens (kind ``tail``), in closed form from a running sum; an unfilled last pack is dropped.
    The sum runs within blocks of ``block_rows`` positions, and only the blocks' sums run over a chunk; ``df`` is read
    twice.  Each row's pieces come out of one pass.
    """
    cut = F.floor(F.col("length") / limit)
    rows = df.filter("length > 0").select("chunk", "pos", F.floor(F.col("pos") / block_rows).alias("block"), cut.alias("k"), (F.col("length") - cut * limit).alias("tail"))
    by_chunk = Window.partitionBy("chunk")
    sums = rows.groupBy("chunk", "block").agg(F.sum("tail").alias("sum"))
    earlier = F.sum("sum").over(by_chunk.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sums.select("chunk", "block", F.coalesce(earlier, F.lit(0)).alias("begun"), F.sum("sum").over(by_chunk).alias("total"))
    before = Window.partitionBy("chunk", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("tail").over(before), F.lit(0))).join(blocks, ["chunk", "block"]).withColumn("off", F.col("begun") + F.col("own"))
    piece = lambda kind, pack, first, n: F.struct(F.lit(kind).alias("kind"), pack.alias("pack"), first.cast("long").alias("first"), n.cast("long").alias("n"))
    none = F.array().cast("array<struct<kind:string,pack:bigint,first:bigint,n:bigint>>")
    full = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: piece("full", i, i * limit, F.lit(limit)))).otherwise(none)
    end = F.col("off") + F.col("tail")

    def tail(p: Column) -> Column:
        low, high = F.greatest(F.col("off"), p * limit), F.least(end, (p + 1) * limit)
        return piece("tail", p, F.col("k") * limit + low - F.col("off"), high - low)

    packs = F.sequence(F.floor(F.col("off") / limit), F.floor((end - 1) / limit))
    tails = F.when(F.col("tail") > 0, F.transform(F.filter(packs, lambda p: (p + 1) * limit <= F.col("total")), tail)).otherwise(none)
    return placed.select("chunk", "pos", F.inline(F.concat(full, tails)))


def repeat_to_fill(df: DataFrame, limit: int) -> DataFrame:
    """Positioned rows repeated to fill ``limit`` tokens: full copies, then the longest prefix that still fits."""
    total = df.agg(F.sum("length")).first()[0] or 0
    if not total:
        return df.withColumn("copy", F.lit(0))
    times = max(1, limit // total)
    whole = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    prefix = running_total(df, "length", "pos", out="__u").filter(F.col("__u") <= limit - times * total).drop("__u").withColumn("copy", F.lit(times))
    return whole.unionByName(prefix)


def position_ids(lengths) -> F.Column:
    """Position ids that restart for each packed sample."""
    return F.flatten(F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))))
