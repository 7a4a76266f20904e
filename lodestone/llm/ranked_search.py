"""Ranked lexical search by Block-Max WAND over a segmented inverted index.

*Index.*  Each task turns its documents into segments of at least ``SEGMENT_TERMS`` term occurrences (the last
one of a task may hold fewer), so building needs no shuffle.  A segment numbers its documents from 0 and holds one
list per term, cut into blocks of ``BLOCK`` postings.  A block's gaps and counts are bit-packed to the widths of its
own largest ones; its head holds the first and last document, the two widths, and the block's maximum impact
as the pairs (occurrences, document length) that no other posting of the block beats in both.  The impact falls
with the length and rises with the occurrences, so the greatest impact among these pairs is the block's exact
maximum whatever the corpus statistics are, and new segments can be added without touching old ones.

*Search.*  Items are dealt to blocks of about ``ITEMS`` items.  The lists of the items' terms meet their segment in one
task, which takes segment after segment and carries each item's ``k`` best with it.  For an item the task
first moves shallow pointers: from block heads alone it sums the maxima of the blocks that span each document,
and every document whose sum is below the item's k-th score is passed over.  Only blocks that still span a candidate
are unpacked, the lists of greatest possible impact first; each takes its maximum out of the candidates' sums and puts
the true impact in, and candidates that fall below the k-th score leave before the next list.  What remains has its
exact score.  The most promising candidates are scored first, to raise the k-th score early.

A bound equal to the k-th score is followed up, since a lesser doc_id wins a tie.  Scores are sums of 64-bit
integers; equal scores rank by ascending doc_id, null last.  Texts that are null or hold no term are in no segment
and count nowhere; an item without terms, or none of whose terms occurs, gets no rows.  Rows that share a doc_id are
ranked each for itself; items that agree in id and text are one item, those that share an id only are ranked apart.  Extra
columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.scratch import materialise

#: Weight scale, and the saturation and length constants of the impact, as the ranking is defined.
WEIGHT, SCALE, SATURATION, FLAT, SLOPE = 1000, 1_000_000_000, 12, 75, 25
TOP = 20
BLOCK = 128
SEGMENT_TERMS = 1 << 22
ITEMS = 256
#: Candidates that are scored before the rest, to raise the k-th score.
FIRST = 256
ROWS = 50_000
_HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("gap_bits", "u1"), ("count_bits", "u1"), ("tops", "<u2")])
_TOP = np.dtype([("count", "<u4"), ("length", "<u4")])
_LISTS = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("heads", pa.binary()), ("tops", pa.binary()), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_DDL = "segment long, term string, df int, heads binary, tops binary, packed binary, doc_ids array<long>, lengths array<long>"
#: Bytes that belong to a term keep themselves (A to Z lower-cased); all others become spaces.  Every byte of a non-ASCII character is above 0x7F.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Index:
    """A written index: rows of lists (``term``), and per segment one row of documents (no ``term``)."""

    table: DataFrame
    documents: int
    occurrences: int

    @property
    def lists(self) -> DataFrame:
        return self.table.filter("term IS NOT NULL").drop("doc_ids", "lengths")

    @property
    def segments(self) -> DataFrame:
        return self.table.filter("term IS NULL").select("segment", "doc_ids", "lengths")


class _Numbers(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of non-negative integers."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _slices(buffer: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array that cuts a buffer into pieces of the given byte sizes."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buffer))])


def _competitive(block: np.ndarray, count: np.ndarray, length: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings that no other of their block beats in both count and length: their places in block order, and how many each block has."""
    order = np.lexsort((length, -count, block))
    b, n = block[order], length[order]
    least = np.minimum.accumulate(n + (blocks - b) * (int(length.max()) + 1))  # falls by more than any length at each new block
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = least[1:] < least[:-1]
    return order[keep], np.bincount(b[keep], minlength=blocks)


def pack(numbers: np.ndarray, lengths: np.ndarray, n_terms: int, block_size: int = BLOCK) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """One segment's ``df, heads, tops, packed`` by term, from term numbers in document order and the documents' lengths."""
    docs = len(lengths)
    keys = numbers.astype(np.int64) * docs + np.repeat(np.arange(docs, dtype=np.int64), lengths)
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(starts, len(keys)))
    term, doc = np.divmod(keys[starts], docs)
    df = np.bincount(term, minlength=n_terms)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(df) - df, df)
    first_of = np.flatnonzero(place % block_size == 0)
    held = np.diff(np.append(first_of, len(doc)))
    block = np.repeat(np.arange(len(first_of)), held)
    within = np.arange(len(doc)) - first_of[block]
    gaps = np.diff(doc, prepend=0) - 1
    gaps[first_of] = 0
    more = count - 1
    heads = np.zeros(len(first_of), dtype=_HEAD)
    heads["first"], heads["last"] = doc[first_of], doc[first_of + held - 1]
    gap_bits, count_bits = _bits(np.maximum.reduceat(gaps, first_of)), _bits(np.maximum.reduceat(more, first_of))
    heads["gap_bits"], heads["count_bits"] = gap_bits, count_bits
    gap_bytes, count_bytes = (held * gap_bits + 7) // 8, (held * count_bits + 7) // 8
    size = gap_bytes + count_bytes
    at = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, dtype=np.uint8)
    for values, width, begin in ((gaps, gap_bits, at), (more, count_bits, at + gap_bytes)):
        wide = np.flatnonzero(width[block] > 0)
        place_of = begin[block[wide]] * 8 + within[wide] * width[block[wide]]
        for j in range(int(width.max(initial=0))):
            on = width[block[wide]] > j
            bits[place_of[on] + j] = (values[wide[on]] >> j) & 1
    kept, per_block = _competitive(block, count, lengths[doc], len(first_of))
    heads["tops"] = per_block
    tops = np.empty(len(kept), dtype=_TOP)
    tops["count"], tops["length"] = count[kept], lengths[doc[kept]]
    first_block = np.flatnonzero(place[first_of] == 0)
    per_list = lambda x: np.add.reduceat(x, first_block)
    return df, _slices(heads, per_list(np.full(len(heads), _HEAD.itemsize))), _slices(tops, per_list(per_block) * _TOP.itemsize), _slices(np.packbits(bits, bitorder="little"), per_list(size))


def _segments(batches):
    """Segments of the task's documents, as rows of the index."""
    task, made = TaskContext.get().partitionId(), 0
    numbers, parts, ids, total = _Numbers(), [], [], 0

    def flush():
        segment = (task << 32) | made
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        df, heads, tops, packed = pack(np.concatenate(parts), lengths, len(numbers))
        names = pa.array(list(numbers), pa.binary()).cast(pa.string())
        none = pa.nulls(len(names), _LISTS.field("doc_ids").type)
        lists = pa.RecordBatch.from_arrays([pa.array(np.full(len(names), segment)), names, pa.array(df.astype(np.int32)), heads, tops, packed, none, none], schema=_LISTS)
        yield pa.RecordBatch.from_pylist([{"segment": segment, "doc_ids": ids, "lengths": lengths.tolist()}], schema=_LISTS)
        for at in range(0, len(names), ROWS):
            yield lists.slice(at, ROWS)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = terms(text.as_py())
            if not found:
                continue
            parts.append(np.array(list(map(numbers.__getitem__, found)), dtype=np.int32))
            ids.append(doc_id)
            total += len(found)
            if total >= SEGMENT_TERMS:
                yield from flush()
                made += 1
                numbers, parts, ids, total = _Numbers(), [], [], 0
    if parts:
        yield from flush()


def build_index(docs: DataFrame) -> Index:
    """Index every term of every text of ``docs`` (``doc_id, text``)."""
    table = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_segments, _DDL), "index")
    index = Index(table, 0, 0)
    sizes = index.segments.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    index.documents, index.occurrences = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return index


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, term, repeats`` of items with their key."""

    def run(batches):
        for b in batches:
            found = [terms(t.as_py()) for t in b.column(1)]
            key = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())], ["item", "term"])

    return items.select("item", "text").mapInArrow(run, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


class Segment:
    """The lists of one segment that a block of items asks for."""

    def __init__(self, doc_ids, lengths: np.ndarray, rows: list[tuple[bytes, bytes, bytes, int]], documents: int, occurrences: int):
        self.norm = FLAT + (SLOPE * lengths * documents) // occurrences
        self.missing = np.array([d is None for d in doc_ids])
        self.ids = np.array([0 if d is None else d for d in doc_ids], dtype=np.int64)
        heads = np.frombuffer(b"".join(r[0] for r in rows), dtype=_HEAD)
        tops = np.frombuffer(b"".join(r[1] for r in rows), dtype=_TOP)
        self.first, self.last = heads["first"].astype(np.int64), heads["last"].astype(np.int64)
        impacts = self.impact(tops["count"].astype(np.int64), FLAT + (SLOPE * tops["length"].astype(np.int64) * documents) // occurrences)
        n_tops = heads["tops"].astype(np.int64)
        self.most = np.maximum.reduceat(impacts, np.cumsum(n_tops) - n_tops)
        blocks = np.array([len(r[0]) // _HEAD.itemsize for r in rows])
        self.end = np.cumsum(blocks)
        self.begin = self.end - blocks
        self.list_most = np.maximum.reduceat(self.most, self.begin)
        self.held = np.full(len(heads), BLOCK)
        self.held[self.end - 1] = np.array([r[3] for r in rows]) - (blocks - 1) * BLOCK
        self.gap_bits, self.count_bits = heads["gap_bits"].astype(np.int64), heads["count_bits"].astype(np.int64)
        size = (self.held * self.gap_bits + 7) // 8 + (self.held * self.count_bits + 7) // 8
        self.at = np.cumsum(size) - size
        self.packed = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def impact(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The weightless score of a posting; rises with the count and falls with the norm."""
        return (SCALE * count) // (1000 * count + SATURATION * norm)

    def _read(self, at: int, n: int, width: int) -> np.ndarray:
        if not width:
            return np.zeros(n, dtype=np.int64)
        bits = np.unpackbits(self.packed[at : at + (n * width + 7) // 8], count=n * width, bitorder="little")
        return bits.reshape(n, width) @ (1 << np.arange(width, dtype=np.int64))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block, unpacked when first needed."""
        if b not in self.unpacked:
            n, width, at = int(self.held[b]), int(self.gap_bits[b]), int(self.at[b])
            steps = self._read(at, n, width) + 1
            steps[0] = self.first[b]
            docs = np.cumsum(steps)
            self.unpacked[b] = docs, self.impact(self._read(at + (n * width + 7) // 8, n, int(self.count_bits[b])) + 1, self.norm[docs])
        return self.unpacked[b]

    def bounds(self, lists: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per document the sum of the weighted maxima of the blocks that span it, from block heads alone."""
        n = self.end[lists] - self.begin[lists]
        blocks = np.arange(n.sum()) + np.repeat(self.begin[lists] - (np.cumsum(n) - n), n)
        most = self.most[blocks] * np.repeat(weights, n)
        steps = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(steps, self.first[blocks], most)
        np.subtract.at(steps, self.last[blocks] + 1, most)
        return np.cumsum(steps[:-1])

    def scores(self, docs: np.ndarray, bound: np.ndarray, lists: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose score is ``least`` or more, with their scores; ``docs`` ascend and ``bound`` holds their bounds."""
        for i in np.argsort(-self.list_most[lists] * weights, kind="stable"):
            if not len(docs):
                break
            begin, end, weight = int(self.begin[lists[i]]), int(self.end[lists[i]]), int(weights[i])
            b = begin + np.searchsorted(self.last[begin:end], docs)
            spanned = np.flatnonzero(b < end)
            spanned = spanned[self.first[b[spanned]] <= docs[spanned]]
            if len(spanned):
                need = b[spanned]
                bound[spanned] -= weight * self.most[need]
                parts = [self.block(int(x)) for x in np.unique(need)]
                held, impacts = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
                place = np.minimum(np.searchsorted(held, docs[spanned]), len(held) - 1)
                hit = held[place] == docs[spanned]
                bound[spanned[hit]] += weight * impacts[place[hit]]
                keep = bound >= least
                docs, bound = docs[keep], bound[keep]
        return docs, bound


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc_id, self.missing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def least(self) -> int:
        """The score that a document needs to be of interest."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, missing: np.ndarray) -> None:
        score, doc_id, missing = (np.concatenate(x) for x in ((self.score, score), (self.doc_id, doc_id), (self.missing, missing)))
        order = np.lexsort((doc_id, missing, -score))[: self.k]
        self.score, self.doc_id, self.missing = score[order], doc_id[order], missing[order]


def rank_segment(segment: Segment, lists: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Add the segment's documents to an item's best."""
    if int(segment.list_most[lists] @ weights) < best.least:
        return
    bound = segment.bounds(lists, weights)
    docs = np.flatnonzero(bound >= best.least)
    if len(docs) > 2 * FIRST:
        front = np.sort(docs[np.argpartition(-bound[docs], FIRST)[:FIRST]])
        rounds = [front, np.setdiff1d(docs, front, assume_unique=True)]
    else:
        rounds = [docs]
    for part in rounds:
        part = part[bound[part] >= best.least]
        found, score = segment.scores(part, bound[part], lists, weights, best.least)
        best.add(score, segment.ids[found], segment.missing[found])


def _ranker(documents: int, occurrences: int, k: int):
    """The task of :func:`search`: rows of block, segment and list in order, the segment's documents first."""

    def run(batches):
        block, segment, docs, rows, uses, best = None, None, None, [], [], {}

        def rank():
            held = Segment(*docs, rows, documents, occurrences)
            by_item: dict[int, list[tuple[int, int]]] = {}
            for i, use in enumerate(uses):
                for u in use:
                    by_item.setdefault(u["item"], []).append((i, u["weight"]))
            for item, pairs in by_item.items():
                lists, weights = np.array(pairs, dtype=np.int64).T
                rank_segment(held, lists, weights, best.setdefault(item, Best(k)))

        def result():
            for item, b in best.items():
                ids = pa.array(b.doc_id, mask=b.missing)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), ids, pa.array(b.score)], ["item", "doc_id", "score"])

        for batch in batches:
            blocks, segments, names = (batch.column(c).to_pylist() for c in ("block", "segment", "term"))
            for i, (b, s, name) in enumerate(zip(blocks, segments, names, strict=True)):
                if (b, s) != (block, segment):
                    if rows:
                        rank()
                    if b != block:
                        yield from result()
                        best = {}
                    block, segment, rows, uses = b, s, [], []
                if name is None:
                    docs = batch.column("doc_ids")[i].as_py(), np.array(batch.column("lengths")[i].as_py(), dtype=np.int64)
                else:
                    rows.append((*(batch.column(c)[i].as_py() for c in ("heads", "tops", "packed")), batch.column("df")[i].as_py()))
                    uses.append(batch.column("uses")[i].as_py())
        if rows:
            rank()
        yield from result()

    return run


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item (``item_id, text``): ``item_id, rank, doc_id, score``."""
    keyed = materialise(items.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text")), "items")
    blocks = max(1, -(-keyed.count() // ITEMS))
    asked = materialise(_item_terms(keyed), "item-terms")
    # the frequency of a term is the sum over its segments
    frequency = index.lists.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(frequency, "term").select(F.pmod("item", F.lit(blocks)).alias("block"), "term", F.struct("item", (weight * F.col("repeats")).alias("weight")).alias("use"))
    used = materialise(weighed.filter("use.weight > 0").groupBy("block", "term").agg(F.collect_list("use").alias("uses")), "item-weights")
    lists = index.lists.join(used, "term").select("block", "segment", "term", "df", "heads", "tops", "packed", "uses")
    every = index.segments.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    rows = lists.unionByName(every, allowMissingColumns=True).repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("term").asc_nulls_first())
    found = rows.mapInArrow(_ranker(index.documents, index.occurrences, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(keyed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
