"""Benchmark decontamination by latent semantic retrieval.

*Space.*  Documents are cut into cells of 32 tokens.  Every token of the corpus is hashed to one of ``BUCKETS``
terms; TF-IDF weights use document frequencies over all cells of all documents, and terms in more than
``MAX_SHARE`` of the cells weigh nothing, as stop words.  A randomised SVD of the cell matrix A gives the latent
space: tasks add up their parts of Y = A'(A R) for a sparse random sign matrix R of ``RANK + OVERSAMPLING`` columns, a sum of
fixed size whatever the corpus.  From that one pass the driver takes the singular values and right singular vectors of A
(Nystrom: A'A is close to Y (R'Y)^-1 Y').

*Search.*  Items are cut into segments of at most 32 tokens and folded in, so a passage of two neighbouring cells
holds any segment whole.  Every passage is compared with every segment (a stated query set against all rows, in
blocks of ``BLOCK_TOKENS`` benchmark tokens over documents that were tokenised once).  A space of fixed rank loses
pairs as the benchmark grows, so a second route adds every pair that could be accepted for its tokens: such a
passage lacks only so many of a segment's terms, so it holds a stated number of the rarest ones, which
postings count (``tests_of``).

*Decision.*  The pairs of either route are decided by the longest common subsequence of their tokens and,
where that is only partial, by the answer terms: those of ``answer_col`` if it is given, else the segment's
rarest third.  A paraphrase whose common subsequence is shorter still is accepted at ``NEAR`` of the tokens if the
passage is as close as ``CLOSE`` in the latent space and holds the answer terms.

A match of any segment counts; (doc_id, item_id) pairs are returned once, with the best share.  Null or empty documents and
items never match, nor do null ids of items.  Repeated items are matched each on their own.  An item with fewer than ``MIN_TOKENS`` tokens is matched by its
exact token sequence, if it has ``MIN_CHARS`` letters and digits; shorter ones identify nothing and are not
searched.  Characters of scripts that put no spaces between words are tokens of their own.  Tokens are
compared by 32-bit hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import WordHashes, mix
from lodestone.plans.scratch import materialise

CELL, SEGMENT, MIN_TOKENS, MIN_CHARS = 32, 32, 5, 12
BUCKETS, RANK, OVERSAMPLING, SIGNS, SEED = 1 << 15, 64, 16, 4, 42
MAX_SHARE = 0.002
COSINE, CLOSE, WHOLE, PART, NEAR, ANSWER, SURE = 0.4, 0.7, 0.8, 0.6, 0.5, 0.6, 0.95
#: Terms of a test beyond those that an accepted passage may lack: a cost, not a limit.
SPARE = 4
PAIRS_AT_ONCE = 2_000_000
BLOCK_TOKENS = 200_000
CELLS_AT_ONCE = 3_000
ROUNDS = 24
TERMS_PER_PART = 512
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_SPACED_TOKEN = re.compile(r"[^\W_]+")


def _spaced(text: str) -> bool:
    """Whether the text surely has no character of an unspaced script: a cheap test for the common case."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; single characters of unspaced scripts."""
    return (_SPACED_TOKEN if _spaced(text) else _TOKEN).findall(text.lower()) if text else []


class TokenHashes(WordHashes):
    """Tokens to 32-bit hashes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def token_hashes(text: str | None, known: TokenHashes) -> np.ndarray:
    """The text's tokens as signed 32-bit hashes."""
    words = tokens(text)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)).view(np.int32)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    """The term of each token."""
    return ids & (BUCKETS - 1)


def _sequence(ids: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` tokens."""
    out = np.full(max(0, len(ids) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = mix(out + ids[i : len(ids) - n + 1 + i].astype(np.int64).view(np.uint64))
    return out


@dataclass
class Segments:
    """One block of the benchmark: segments, and short items by the hash of their token sequence."""

    item: list[int] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    answers: list[list[int] | None] = field(default_factory=list)
    short: dict[int, list[tuple[list[int], int]]] = field(default_factory=lambda: defaultdict(list))
    size: int = 0


def segments(benchmark: DataFrame, answer_col: str | None = None) -> Iterator[Segments]:
    """Blocks of the benchmark, each of about ``BLOCK_TOKENS`` tokens."""
    known = TokenHashes()
    answer = F.lit(None).cast("string") if answer_col is None else F.col(f"`{answer_col}`")
    block = Segments()
    for item, text, given in benchmark.select("item_id", "text", answer.alias("answer")).filter("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        ids = token_hashes(text, known).tolist()
        if len(ids) < MIN_TOKENS:
            if sum(map(len, tokens(text))) >= MIN_CHARS:
                block.short[int(_sequence(np.array(ids, dtype=np.int32), len(ids))[0])].append((ids, item))
                block.size += len(ids)
        else:
            answers = token_hashes(given, known).tolist() or None
            parts = -(-len(ids) // SEGMENT)
            for p in range(parts):
                block.item.append(item)
                block.ids.append(ids[p * len(ids) // parts : (p + 1) * len(ids) // parts])
                block.answers.append(answers)
                block.size += len(block.ids[-1])
                if block.size >= BLOCK_TOKENS:
                    yield block
                    block = Segments()
        if block.size >= BLOCK_TOKENS:
            yield block
            block = Segments()
    if block.size:
        yield block


class Tokens:
    """Documents as one array of token hashes and the bounds of each document in it."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds = values, bounds

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Tokens:
        bounds = np.cumsum([0, *map(len, docs)])
        return cls(np.concatenate(docs) if docs else np.zeros(0, np.int32), bounds)

    @classmethod
    def of_arrow(cls, lists: pa.ListArray) -> Tokens:
        return cls(lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy())

    def portions(self, overlap: int = 0) -> Iterator[Portion]:
        """Runs of documents of bounded total length; a longer document is cut at cells, with ``overlap`` cells in both pieces."""
        step = CELLS_AT_ONCE * CELL
        bounds, row, n = self.bounds, 0, len(self.bounds) - 1
        while row < n:
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + step, side="right")) - 1)
            if bounds[last] - bounds[row] <= step:
                yield Portion(self.values[bounds[row] : bounds[last]], np.arange(row, last), np.diff(bounds[row : last + 1]))
            else:
                for a in range(bounds[row], bounds[last], step):
                    piece = self.values[a : min(a + step + overlap * CELL, bounds[last])]
                    yield Portion(piece, np.array([row]), np.array([len(piece)]))
            row = last


class Portion:
    """Pieces of documents side by side: their tokens, the document of each, and their cells."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        self.ids, self.rows, self.lengths = ids, rows, lengths
        per_piece = -(-lengths // CELL)
        self.starts = np.cumsum(lengths) - lengths
        self.first = np.cumsum(per_piece) - per_piece
        self.cells = int(per_piece.sum())
        self.owner = np.repeat(np.arange(len(rows)), per_piece)
        self.term = bucket_of(ids)

    def cell_of(self, places: np.ndarray) -> np.ndarray:
        """The cells of the tokens at these places."""
        piece = np.searchsorted(self.starts + self.lengths, places, side="right")
        return self.first[piece] + (places - self.starts[piece]) // CELL

    def frequency(self) -> np.ndarray:
        """In how many cells each term occurs."""
        grid = np.full((self.cells, CELL), BUCKETS, dtype=np.uint16)
        places = np.arange(len(self.ids))
        piece = np.repeat(np.arange(len(self.rows)), self.lengths)
        inside = places - self.starts[piece]
        grid[self.first[piece] + inside // CELL, inside % CELL] = self.term
        grid.sort(axis=1)
        fresh = np.ones(grid.shape, dtype=bool)
        fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
        return np.bincount(grid[fresh], minlength=BUCKETS + 1)[:BUCKETS]


def _add_rows(out: np.ndarray, index: np.ndarray, source: np.ndarray, take: np.ndarray) -> None:
    """``out[index] += source[take]`` with repeats counted: a round adds the next row of every place; places of many rows are summed at the end."""
    order = np.argsort(index, kind="stable")
    index, take = index[order], take[order]
    starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    times = np.diff(np.r_[starts, len(index)])
    for r in range(min(ROUNDS, int(times.max()))):
        at = starts[times > r]
        out[index[at]] += source[take[at + r]]
    rest = np.flatnonzero(np.arange(len(index)) - np.repeat(starts, times) >= ROUNDS)
    if len(rest):
        at = np.flatnonzero(np.r_[True, index[rest][1:] != index[rest][:-1]])
        out[index[rest[at]]] += np.add.reduceat(source[take[rest]], at, axis=0)


def _parts(total: np.ndarray, kind=np.float64) -> pd.DataFrame:
    """A matrix as rows of bounded size."""
    at = list(range(0, len(total), TERMS_PER_PART))
    return pd.DataFrame({"part": at, "sums": [total[i : i + TERMS_PER_PART].astype(kind).tobytes() for i in at]})


def _summed(parts: DataFrame, rows: int, columns: int, kind=np.float64) -> np.ndarray:
    """The sum of matrices that tasks gave as :func:`_parts`."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(p, dtype=kind).astype(np.float64) for p in frame["sums"])
        return pd.DataFrame({"part": frame["part"][:1], "sums": [whole.tobytes()]})

    out = np.zeros((rows, columns))
    for r in parts.select("part", "sums").groupBy("part").applyInPandas(add, "part int, sums binary").collect():
        x = np.frombuffer(r.sums).reshape(-1, columns)
        out[r.part : r.part + len(x)] = x
    return out


_TOKEN_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("part", pa.int32()), ("sums", pa.binary())])


def _token_rows(kind: int, doc_id, ids, part, sums, n: int) -> pa.RecordBatch:
    given = [pa.array(np.full(n, kind, dtype=np.int32)), doc_id, ids, part, sums]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else x for x, f in zip(given, _TOKEN_SCHEMA, strict=True)], schema=_TOKEN_SCHEMA)


def _tokenise(batches):
    known = TokenHashes()
    frequency = np.zeros((BUCKETS + 1, 1))
    for b in batches:
        held = Tokens.of([token_hashes(t, known) for t in b.column("text").to_pylist()])
        for part in held.portions():
            frequency[:-1, 0] += part.frequency()
            frequency[-1, 0] += part.cells
        ids = pa.ListArray.from_arrays(pa.array(held.bounds.astype(np.int32)), pa.array(held.values))
        yield _token_rows(0, b.column("doc_id").cast(pa.int64()), ids, None, None, b.num_rows)
    if frequency[-1, 0]:
        sums = _parts(frequency)
        yield _token_rows(1, None, None, pa.array(sums["part"], pa.int32()), pa.array(sums["sums"], pa.binary()), len(sums))


def tokenised(docs: DataFrame) -> DataFrame:
    """All documents as token hashes (kind 0), with per-task counts of the cells that hold each term (kind 1)."""
    return materialise(docs.select("doc_id", "text").mapInArrow(_tokenise, "kind int, doc_id long, ids array<int>, part int, sums binary"), "tokens")


def _signs(columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The random matrix R: of each term, the columns that are not zero and their signs."""
    rng = np.random.default_rng(SEED)
    where = np.argsort(rng.random((BUCKETS, columns)), axis=1)[:, :SIGNS]
    return where, rng.choice([-1.0, 1.0], (BUCKETS, SIGNS))


def _sketch(weights: np.ndarray, columns: int):
    """This task's part of Y = A'(A R)."""

    def run(batches):
        where, sign = _signs(columns)
        weighed = weights[:, None] * sign
        total, seen = np.zeros((BUCKETS, columns), dtype=np.float32), False
        for b in batches:
            for part in Tokens.of_arrow(b.column("ids")).portions():
                live = np.flatnonzero(weights[part.term] > 0)
                if not len(live):
                    continue
                seen = True
                term, cell = part.term[live], part.cell_of(live)
                y = np.bincount((cell[:, None] * columns + where[term]).ravel(), weights=weighed[term].ravel(), minlength=part.cells * columns)
                y = y.reshape(-1, columns).astype(np.float32)
                _add_rows(total, term, y, cell)
        if seen:
            total *= weights[:, None].astype(np.float32)
            yield pa.RecordBatch.from_pandas(_parts(total, np.float32), schema=pa.schema([("part", pa.int32()), ("sums", pa.binary())]), preserve_index=False)

    return run


def singular_vectors(product: np.ndarray, columns: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A from Y = A'(A R), the greatest first."""
    where, sign = _signs(columns)
    r = np.zeros((BUCKETS, columns))
    r[np.arange(BUCKETS)[:, None], where] = sign
    core = r.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * values.max()  # the sums have single precision
    u, s, _ = np.linalg.svd(product @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank], s[:rank]


@dataclass
class Space:
    """Cells that hold each term, and the weighted latent vector of each term; of fixed size."""

    frequency: np.ndarray
    terms: np.ndarray
    singular: np.ndarray


def fit(toks: DataFrame, rank: int = RANK, oversampling: int = OVERSAMPLING) -> Space:
    """Document frequencies and the latent space from all tokenised documents."""
    counts = _summed(toks.filter("kind = 1"), BUCKETS + 1, 1)[:, 0]
    frequency, cells = counts[:-1], counts[-1]
    weights = np.log((1 + cells) / (1 + frequency)) * ((frequency > 0) & (frequency <= max(1.0, MAX_SHARE * cells)))
    columns = rank + oversampling
    # few tasks, so that what they add up does not grow with the corpus
    docs = toks.filter("kind = 0").select("ids").coalesce(2 * toks.sparkSession.sparkContext.defaultParallelism)
    product = _summed(docs.mapInArrow(_sketch(weights, columns), "part int, sums binary"), BUCKETS, columns, np.float32)
    if not product.any():
        return Space(frequency, np.zeros((BUCKETS, rank), dtype=np.float32), np.zeros(rank))
    vectors, values = singular_vectors(product, columns, rank)  # fewer than the rank if the corpus has fewer
    return Space(frequency, (weights[:, None] * vectors).astype(np.float32), values)


@dataclass
class Model:
    """What a scan needs: bounded by one block of the benchmark."""

    segs: Segments
    space: Space
    items: np.ndarray  # unit vector of each segment
    rare: list[list[int]]
    tests: list[tuple[list[int], int]]  # two of each segment


def _least(n: int, share: float) -> int:
    """The least count whose share of ``n`` reaches ``share``."""
    return next(k for k in range(n + 1) if k / n >= share)


def tests_of(ids: list[int], rare: list[int], given: bool, frequency: np.ndarray) -> list[tuple[list[int], int]]:
    """Terms and the number of them that a passage holds; an accepted passage passes one of the two at least.

    A passage is accepted for the share of the segment's tokens in it, or for that of the answer terms.
    """
    out = []
    for terms, share in ((ids, SURE if given else WHOLE), (rare, ANSWER)):
        lacking = len(terms) - _least(len(terms), share)
        listed = sorted(set(terms), key=lambda t: (frequency[t], t))[: lacking + SPARE]
        out.append((listed, max(1, len(listed) - lacking)))
    return out


def prepare(segs: Segments, space: Space) -> Model:
    """One block of the benchmark, folded into the space."""
    of = lambda ids: bucket_of(np.array(ids, dtype=np.int32))
    items = np.array([space.terms[of(i)].sum(axis=0) for i in segs.ids], dtype=np.float32).reshape(-1, space.terms.shape[1])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
    frequency = {t: space.frequency[t & (BUCKETS - 1)] for i, a in zip(segs.ids, segs.answers, strict=True) for t in [*i, *(a or ())]}
    rare = [a or sorted(set(i), key=lambda t: (frequency[t], t))[: max(3, len(set(i)) // 3)] for i, a in zip(segs.ids, segs.answers, strict=True)]
    tests = [t for i, r, a in zip(segs.ids, rare, segs.answers, strict=True) for t in tests_of(i, r, a is not None, frequency)]
    return Model(segs, space, items.astype(np.float32), rare, tests)


def subsequence(masks: dict[int, int], n: int, words) -> int:
    """Length of the longest common subsequence with the segment of ``n`` tokens whose positions by token are ``masks``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


class Scanner:
    """Finds the benchmark's items in documents given as token hashes."""

    def __init__(self, model: Model):
        self.m = model
        self.masks, self.sets = [], []
        for ids in model.segs.ids:
            mask: dict[int, int] = {}
            for p, t in enumerate(ids):
                mask[t] = mask.get(t, 0) | 1 << p
            self.masks.append(mask)
            self.sets.append(frozenset(ids))
        self.live = np.abs(model.space.terms).max(axis=1) > 0
        self.vocabulary, term = np.unique(np.array([t for terms, _ in model.tests for t in terms], dtype=np.int32), return_inverse=True)
        self.listed = np.zeros(BUCKETS, dtype=bool)
        self.listed[bucket_of(self.vocabulary)] = True
        self.posting = np.repeat(np.arange(len(model.tests)), np.array([len(terms) for terms, _ in model.tests], dtype=np.int64))[np.argsort(term, kind="stable")]
        self.postings = np.bincount(term, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.postings) - self.postings
        self.needed = np.array([n for _, n in model.tests])
        self.lengths = sorted({len(ids) for found in model.segs.short.values() for ids, _ in found})
        self.sequences = np.array(sorted(model.segs.short), dtype=np.uint64)

    def exact(self, part: Portion) -> tuple[np.ndarray, np.ndarray]:
        """Passages and segments, by passage, of all pairs that pass a test; these include all that ``accept`` can accept for their tokens."""
        size, tests, owner = len(self.postings), len(self.needed), part.owner
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.listed[part.term])
        ids = part.ids[maybe]
        place = np.minimum(np.searchsorted(self.vocabulary, ids), size - 1)
        listed = self.vocabulary[place] == ids
        ids, cell = place[listed], part.cell_of(maybe[listed])
        second = cell > 0
        second[second] = owner[cell[second] - 1] == owner[cell[second]]
        passage, term = np.divmod(np.unique(np.r_[cell * size + ids, (cell[second] - 1) * size + ids[second]]), size)
        n = self.postings[term]
        ends = np.cumsum(n)
        out, a = [], 0
        while a < len(term):
            z = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS_AT_ONCE, side="right")))
            if z < len(term):  # a passage is counted in one go
                start = int(np.searchsorted(passage, passage[z]))
                z = start if start > a else int(np.searchsorted(passage, passage[z], side="right"))
            times = n[a:z]
            at = np.arange(times.sum()) + np.repeat(self.first[term[a:z]] - (np.cumsum(times) - times), times)
            pairs, count = np.unique(np.repeat(passage[a:z], times) * tests + self.posting[at], return_counts=True)
            out.append(np.unique(pairs[count >= self.needed[pairs % tests]] // 2))
            a = z
        return np.divmod(np.concatenate(out) if out else np.zeros(0, np.int64), tests // 2)

    def accept(self, s: int, words: list[int], here: set[int], cosine: float) -> float:
        """The matched share of segment ``s`` in a passage, 0 if it is no match."""
        own, n = self.sets[s], len(self.m.segs.ids[s])
        if len(own & here) < 0.4 * len(own):
            return 0.0
        share = subsequence(self.masks[s], n, words) / n
        if share < (NEAR if cosine >= CLOSE else PART):
            return 0.0
        rare = self.m.rare[s]
        known = sum(t in here for t in rare) / len(rare)
        return share if (share >= WHOLE and self.m.segs.answers[s] is None) or share >= SURE or known >= ANSWER else 0.0

    def _short(self, part: Portion) -> Iterator[tuple[int, int]]:
        """(row, item_id) of the short items."""
        ends = part.starts + part.lengths
        for n in self.lengths:
            found = _sequence(part.ids, n)
            for i in np.flatnonzero(np.isin(found, self.sequences)).tolist():
                piece = int(np.searchsorted(ends, i, side="right"))
                if i + n <= ends[piece]:
                    yield from ((int(part.rows[piece]), item) for own, item in self.m.segs.short[int(found[i])] if own == part.ids[i : i + n].tolist())

    def find(self, docs: Tokens) -> list[tuple[int, int, float, float]]:
        """(row, item_id, cosine, matched share), the best of each row and item."""
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for part in docs.portions(overlap=1):
            if not len(part.ids):
                continue
            for key in self._short(part):
                best[key] = (1.0, 1.0)
            passage, segment = self.exact(part)
            live = np.flatnonzero(self.live[part.term])
            x = np.zeros((part.cells, self.m.space.terms.shape[1]), dtype=np.float32)
            if len(live):
                _add_rows(x, part.cell_of(live), self.m.space.terms, part.term[live])
            same = np.flatnonzero(part.owner[1:] == part.owner[:-1])
            x[same] += x[same + 1]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for a in range(0, len(self.m.items), 1000):
                cosine = x @ self.m.items[a : a + 1000].T
                near, here = cosine >= COSINE, (segment >= a) & (segment < a + 1000)
                near[passage[here], segment[here] - a] = True
                last = -1
                for c, j in np.argwhere(near).tolist():
                    if c != last:
                        last, piece = c, part.owner[c]
                        first = part.starts[piece] + (c - part.first[piece]) * CELL
                        words = part.ids[first : min(first + 2 * CELL, part.starts[piece] + part.lengths[piece])].tolist()
                        held = set(words)
                    if share := self.accept(a + j, words, held, cosine[c, j]):
                        key = (int(part.rows[piece]), self.m.segs.item[a + j])
                        best[key] = max(best.get(key, (0.0, 0.0)), (share, float(cosine[c, j])))
        return [(r, i, c, s) for (r, i), (s, c) in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """``doc_id, item_id, cosine, matched``: every pair of a document and an item that it holds, once."""
    toks, space, out = None, None, None
    for segs in segments(benchmark, answer_col):
        if space is None:
            toks = tokenised(docs)
            space = fit(toks)
        model = prepare(segs, space)

        def search(batches, model=model):
            scanner = Scanner(model)
            for b in batches:
                if found := scanner.find(Tokens.of_arrow(b.column("ids"))):
                    rows, items, cosines, shares = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(cosines, pa.float64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "cosine", "matched"])

        rows = toks.filter("kind = 0").select("doc_id", "ids").mapInArrow(search, "doc_id long, item_id long, cosine double, matched double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, matched double")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "cosine")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """The documents that hold no item; each row decides by its own text, so nothing is joined or shuffled."""
    space = None
    for segs in segments(benchmark, answer_col):
        if space is None:
            space = fit(tokenised(docs))
        docs = docs.filter(_clean_udf(prepare(segs, space))(F.col("text")))
    return docs


def _clean_udf(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner, known = Scanner(model), TokenHashes()
        for texts in batches:
            found = scanner.find(Tokens.of([token_hashes(t, known) for t in texts]))
            out = np.ones(len(texts), dtype=bool)
            out[[f[0] for f in found]] = False
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")
