"""Grouping of spelling variants by two-dimensional range reporting on wavelet trees.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  Among the words of one
length, each is a point: its rank in code-point order, and its rank in the order of the words read backwards.  The
words that a query can become by an edit at position i are the points in a rectangle: the interval of its
prefix before i, times the interval of its suffix after i.  A wavelet tree over the backward ranks in forward
order reports the points of a rectangle in logarithmic time each, all rectangles of a batch level by level at once.

*Distribution.*  Of the prefix and the suffix at an edit position, one covers half of the word.  So the words of a
length are dealt by a hash of their first half, a query goes to the one bin of its own first half for each of
the three lengths, and is searched there at the positions behind that half; the same is done with all words reversed
for the other positions.  Bins hold about ``CHUNK`` words; words that share a half and are more than that are spread over as
many parts, which the queries with that half visit all.  A task holds the points of one bin and streams the queries.

A near word that several positions give (in a run of equal letters) counts at the first of them alone, so each
pair is met once from each of its words, and only a count and the best near word of each visit leave a task.

Texts that are null or empty have no words; very long texts are one row like others; repeated rows count as often as
they occur; a null doc_id is written ``null``.  Ties for the best near word go to the least in code-point order.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import discard, materialise

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form is at least so many times as frequent.
RATIO = 5
CHUNK = 1 << 15
HELD = 1 << 18
LAST = 0x10FFFF
#: Latin-1 bytes of letters keep themselves (A to Z lower-cased); all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """``word, n`` of the words of all texts (``doc_id, text``): runs of A-Z, a-z and U+00C0 to U+00FF, A to Z lower-cased.

    With ``damage``, a run whose CRC-32 of ``doc_id:run`` is a multiple of it loses the code point at that CRC modulo its length.
    """

    def run(batches):
        counts: Counter = Counter()

        def result():
            words = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a character beyond Latin-1 becomes a question mark, and so a space
                found = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_FOLD).split())
                seed = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    size = len(word)
                    if size < least_length:
                        continue
                    if damage:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if h % damage == 0:
                            at = h % size
                            word, size = word[:at] + word[at + 1 :], size - 1
                            if size < least_length:
                                continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield result()
                    counts = Counter()
        if counts:
            yield result()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0..n-1; reports which of its values in a range of places lie in a range of values."""

    def __init__(self, values: np.ndarray):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(len(values) - 1).bit_length())
        for b in reversed(range(self.bits)):
            zero = (values >> b) & 1 == 0
            self.levels.append(np.concatenate([[0], np.cumsum(zero)]))
            self.zeros.append(int(self.levels[-1][-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectangle number and value of every point in the rectangles [low, high) x [least, most)."""
        rect, value = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for depth, b in enumerate(reversed(range(self.bits))):
            before = self.levels[depth]
            zlow, zhigh = before[low], before[high]
            rect = np.concatenate([rect, rect])
            value = np.concatenate([value, value | (1 << b)])
            low, high = np.concatenate([zlow, low - zlow + self.zeros[depth]]), np.concatenate([zhigh, high - zhigh + self.zeros[depth]])
            keep = (low < high) & (value < most[rect]) & (value + (1 << b) > least[rect])
            rect, value, low, high = rect[keep], value[keep], low[keep], high[keep]
        return rect, value


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length)


def _texts(codes: np.ndarray) -> np.ndarray:
    """Rows of code points as strings that compare by code point."""
    return np.ascontiguousarray(codes).view(f"<U{codes.shape[1]}").reshape(-1)


class Points:
    """The words of one length in a bin, as points of forward and backward rank."""

    def __init__(self, words: list[str], counts: np.ndarray, length: int, mirrored: bool):
        codes = _codes(words, length)
        order = np.argsort(_texts(codes), kind="stable")
        self.length, self.mirrored = length, mirrored
        self.codes, self.counts = codes[order], counts[order]
        self.forward = _texts(self.codes)
        backward = _texts(self.codes[:, ::-1])
        self.at = np.argsort(backward, kind="stable")  # place of the word of a backward rank
        self.backward = backward[self.at]
        rank = np.empty(len(words), dtype=np.int64)
        rank[self.at] = np.arange(len(words))
        self.tree = WaveletTree(rank)
        self.order = rank if mirrored else np.arange(len(words))  # order of the words as they are read

    @staticmethod
    def _interval(ordered: np.ndarray, codes: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the words that begin with the first ``n`` code points of each row."""
        bound = np.zeros((len(codes), length), dtype=np.uint32)
        bound[:, :n] = codes[:, :n]
        low = np.searchsorted(ordered, _texts(bound), "left")
        bound[:, n:] = LAST
        return low, np.searchsorted(ordered, _texts(bound), "right")

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the query and place of the near word, each pair once; the queries are words of one length."""
        length, size = self.length, codes.shape[1]
        half = length // 2
        edit = length - size
        whole = length if edit < 0 else length - 1  # length of prefix and suffix together
        first = (length - half if self.mirrored else half) + (self.mirrored and edit < 0)
        back = codes[:, ::-1]
        none = np.zeros(0, dtype=np.int64)
        rects = [(none,) * 6]
        open_rows = np.arange(len(codes))
        if edit == 0 and len(self.codes) == 1:  # a word that meets only itself has nothing to find
            open_rows = np.flatnonzero((codes != self.codes).any(axis=1))
        for i in range(first, whole + 1):
            if not len(open_rows):
                break
            low, high = self._interval(self.forward, codes[open_rows], i, length)
            some = low < high  # no word begins with a longer prefix either
            open_rows, low, high = open_rows[some], low[some], high[some]
            rows = open_rows
            if edit < 0:  # the letter to delete; in a run of equal ones only the first, as read
                beside = i + 1 if self.mirrored else i - 1
                if 0 <= beside < size:
                    lone = codes[rows, i] != codes[rows, beside]
                    rows, low, high = rows[lone], low[lone], high[lone]
            least, most = self._interval(self.backward, back[rows], whole - i, length)
            some = least < most
            rects.append((rows[some], np.full(int(some.sum()), i), low[some], high[some], least[some], most[some]))
        rows, place, low, high, least, most = (np.concatenate(x) for x in zip(*rects, strict=True))
        rect, rank = self.tree.report(low, high, least, most)
        query, i, found = rows[rect], place[rect], self.at[rank]
        if edit == 0:
            keep = self.codes[found, i] != codes[query, i]
        elif edit > 0:  # the letter inserted; in a run of equal ones only the first, as read
            beside = i + 1 if self.mirrored else i - 1
            inside = (beside >= 0) & (beside < length)
            keep = ~inside | (self.codes[found, i] != self.codes[found, np.clip(beside, 0, length - 1)])
        else:
            keep = np.ones(len(query), dtype=bool)
        return query[keep], found[keep]

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries with near words: their row, the number of these, and the place of the most frequent one."""
        query, found = self.near(codes)
        order = np.lexsort((self.order[found], -self.counts[found], query))
        query, found = query[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, dtype=int)
        return query[first], np.diff(np.append(first, len(query))), found[first]


def _visits(mirrored: bool):
    """The task: rows of length, bin, part, kind and size in order, a bin's points before its queries."""

    def run(batches):
        key, words, counts, points = None, [], [], None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "bin", "part", "kind", "size")]
            text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, b in zip([0, *turns], [*turns, len(text)], strict=True):
                if a == b:
                    continue
                length, bin_, part, kind, size = (int(c[a]) for c in cols)
                if key != (length, bin_, part):
                    key, words, counts, points = (length, bin_, part), [], [], None
                if kind == 0:
                    words += text[a:b]
                    counts.append(n[a:b])
                    continue
                if not words:
                    continue
                if points is None:
                    points = Points(words, np.concatenate(counts), length, mirrored)
                rows, near, place = points.best(_codes(text[a:b], size))
                if len(rows):
                    turn = (lambda w: w[::-1]) if mirrored else (lambda w: w)
                    found = [turn(str(w)) for w in points.forward[place]]
                    asked = [turn(text[a + r]) for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(near, pa.int64()), pa.array(points.counts[place], pa.int64()), pa.array(found)], ["word", "n_near", "form_n", "form"])

    return run


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word, n_near, form_n, form`` of the distinct non-empty words (``word, n``) that have near ones: their number and the most frequent, ties by code point."""
    sized = words.select("word", "n", F.length("word").alias("size"))
    bins = materialise(sized.groupBy(F.col("size").alias("length")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("bins")), "lengths")
    out = None
    for mirrored in (False, True):
        read = sized.withColumn("word", F.reverse("word")) if mirrored else sized
        half = F.left(F.col("word"), F.floor(F.col("length") / 2).cast("int")).alias("half")
        own = read.withColumn("length", F.col("size")).select("*", half)
        large = materialise(own.groupBy("length", "half").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts")).filter("parts > 1"), "halves")
        asked = read.withColumn("length", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).select("*", half)

        def placed(rows):
            bin_ = F.pmod(F.xxhash64("length", "half"), F.col("bins")).alias("bin")
            return rows.join(bins, "length").join(large, ["length", "half"], "left").select("*", bin_, F.coalesce("parts", F.lit(1)).alias("of"))  # noqa: B023

        points = placed(own).select("length", "bin", F.pmod(F.xxhash64("word"), F.col("of")).alias("part"), F.lit(0).alias("kind"), "size", "word", "n")
        visits = placed(asked).select("length", "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"), F.lit(1).alias("kind"), "size", "word", "n")
        rows = points.unionByName(visits).repartition("length", "bin", "part").sortWithinPartitions("length", "bin", "part", "kind", "size")
        found = rows.mapInArrow(_visits(mirrored), "word string, n_near long, form_n long, form string")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word that forms lead to, by pointer doubling; forms must not lead in a circle."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = moved
        if moved.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word (``word, n``, each word once); a form is at least ``ratio`` times as frequent."""
    held = materialise(words.select("word", "n"), "words")
    near = materialise(near_words(held), "near-words")
    good = F.col("form_n") >= ratio * F.col("n")
    joined = held.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    each = materialise(joined, "forms")
    ends = roots(each.filter("form IS NOT NULL"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
