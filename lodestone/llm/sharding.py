"""Minimax contiguous sharding of ordered atomic groups.

Groups (here: rows of equal text) are ordered by a 60-bit hash of their content.  The smallest shard
capacity is found by binary search with a greedy feasibility check over the group sizes, and the shards
are cut there.  Group sizes never reach the driver as a whole: it holds sums over a tree of key
prefixes, and opens only the nodes into which a cut can still fall, until all those are single groups.
The cuts are then plain thresholds on the key, so rows find their shard without a join.  Slots follow a hash of the row, or an
order that the caller names; rows that tie in it take their slots in any order.

Null text is a group of its own with no bytes.  Repeated rows all stay in their group.  An empty table
gives an empty result.  Two texts whose 60-bit keys collide merely share a group.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.position import with_position
from lodestone.plans.running import HASH_BITS, order_hash, running_sum
from lodestone.plans.scratch import materialise

ROOT_BITS, STEP_BITS = 12, 8


class _Tree:
    """Sizes below key prefixes, opened where needed."""

    def __init__(self, groups: DataFrame, key: str, size: str):
        self.groups, self.key, self.size = groups, key, size
        self.nodes = self._sums(groups, ROOT_BITS)

    def _sums(self, rows: DataFrame, bits: int) -> list[tuple[int, int, bool, int]]:
        """(first key, size, single group, bits), in order."""
        shift = HASH_BITS - bits
        found = rows.groupBy(F.shiftright(self.key, shift).alias("p")).agg(F.sum(self.size).alias("s"), F.min(self.key).alias("a"), F.max(self.key).alias("z")).collect()
        return [(r.p << shift, int(r.s), r.a == r.z, bits) for r in sorted(found, key=lambda r: r.p)]

    def open(self, which: set[int]) -> None:
        """Replace the nodes at these indices by their children."""
        by_bits: dict[int, list[int]] = {}
        for i in which:
            by_bits.setdefault(self.nodes[i][3], []).append(self.nodes[i][0])
        fresh = [n for i, n in enumerate(self.nodes) if i not in which]
        for bits, firsts in by_bits.items():
            shift = HASH_BITS - bits
            inside = self.groups.filter(F.shiftright(self.key, shift).isin([f >> shift for f in firsts]))
            fresh += self._sums(inside, min(HASH_BITS, bits + STEP_BITS))
        self.nodes = sorted(fresh)


def _greedy(ends: list[int], single: list[bool], starts: list[int], capacity: int, shards: int, hopeful: bool) -> tuple[list[int], bool]:
    """Cut positions under a capacity, and whether it is enough.  An unopened node is divisible if hopeful, else atomic."""
    at, cuts, total = 0, [], ends[-1]
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            return cuts + [total] * (shards - len(cuts)), True
        i = bisect_right(ends, reach)
        at = reach if hopeful and not single[i] else max(at, starts[i])
        cuts.append(at)
    return cuts, False


def _least(check, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if check(mid) else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, key: str, size: str, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1 and up, and the least capacity that any contiguous division can reach."""
    tree = _Tree(groups, key, size)
    while tree.nodes:
        ends, at = [], 0
        for n in tree.nodes:
            at += n[1]
            ends.append(at)
        starts, single = [0, *ends[:-1]], [n[2] for n in tree.nodes]
        cut = lambda c, hopeful: _greedy(ends, single, starts, c, shards, hopeful)  # noqa: B023, E731
        low = _least(lambda c: cut(c, True)[1], -(-at // shards), at)
        high = _least(lambda c: cut(c, False)[1], low, at)
        if low == high:
            keys = [n[0] for n in tree.nodes]
            return [keys[i] if (i := bisect_right(starts, c) - 1) >= 0 and starts[i] == c else 1 << HASH_BITS for c in cut(low, False)[0][: shards - 1]], low
        which: set[int] = set()
        for a, z in zip(cut(low, False)[0], cut(high, True)[0], strict=True):
            first, last = bisect_right(ends, a), min(bisect_right(ends, z), len(ends) - 1)
            which |= {i for i in range(first, last + 1) if not single[i]}
        tree.open(which)
    return [], 0


def written_order(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Documents with the columns that tell the order in which their files were written (Spark numbers these by name); none if they come from no files."""
    try:
        place = docs.select("*", docs.metadataColumn("_metadata").alias("written"))
    except AnalysisException:
        return docs, ()
    return place.select("*", F.col("written.file_name").alias("file_order"), F.col("written.row_index").alias("row_order")), ("file_order", "row_order")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: groups of equal text, sizes near equal, slots gapless per shard.

    Slots follow the columns ``order``, or else a hash of the row.
    """
    text = F.col(f"`{text_col}`")
    rows = materialise(
        docs.select(
            *[F.col(f"`{c}`").alias(f"order{i}") for i, c in enumerate(order)],
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            order_hash(text.isNull(), text).alias("group_key"),
            order_hash(F.col(f"`{id_col}`"), F.md5(text)).alias("row_key"),
        ),
        "shard-rows",
    )
    if order:  # places spread over the order key's range
        placed = with_position(rows, *[f"order{i}" for i in range(len(order))], out="place")
        rows = materialise(placed.withColumn("row_key", F.col("place") * ((1 << HASH_BITS) // max(1, rows.count()))), "shard-order")
    cuts, _ = minimax_cuts(rows, "group_key", "size", shards)
    shard = F.lit(0)
    for c in cuts:
        if c < 1 << HASH_BITS:
            shard = shard + (F.col("group_key") >= F.lit(c)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("one", F.lit(1).cast("long"))
    slots = running_sum(placed, ["shard"], "row_key", ["doc_id", "group_key"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
