"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

*Signatures.*  A document is the multiset of its five-word shingles.  Each shingle runs Poisson
processes over a hierarchy of weight layers (0,1], (1,2], (2,4], (4,8] ...: a layer's points come at a
rate equal to its width, carry a uniform weight coordinate and a register, and count if the coordinate,
rounded up, is at most the shingle's multiplicity.  A register keeps its earliest point, and a process stops once it is
later than every register of its document.  Two registers agree with a probability equal to the
weighted Jaccard similarity.

*Bands.*  64 registers in 16 bands of 4: a pair at 0.8 meets with a probability of 0.9998.
Buckets with the same members are kept once.

*Verification.*  Exact multiset Jaccard similarities decide, in rounds.  A bucket of at most ``BLOCK``
texts is compared whole in one task (fewer, if their shingles together exceed ``SHINGLES_AT_ONCE``).  A larger one is dealt to
blocks of that size, and up to ``GUESTS`` of its members visit every block, so a round reads each member
once and each guest once a block: its rows grow with the bucket, not with its square.  A round's links merge classes, the guests, now compared with all,
leave the bucket, and a bucket whose members are all of one class is done.  Once all classes of a bucket but its
largest hold at most ``GUESTS`` members, these are the guests, and nothing is left to compare.  Buckets
still open after ``ROUNDS`` rounds are dealt anew by fresh, longer bands (``LEVELS``: rows and bands, a pair at
0.8 meeting with at least 0.9998), which separate texts that merely resemble each other; at the last level
the rounds go on until every bucket is done, so no member is ever dropped uncompared.

*Classes.*  Connected components by alternating large and small stars.  A class is named by its least
doc_id.  Exact copies share one comparison.

Null text and text without words: equal texts are one class; null texts are never copies of anything.
A text under five words is one shingle.  Rows with a null doc_id only follow their exact copies (class
null if they have none).  Rows that share a doc_id are one document for the classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shingles import WordHashes, as_set, mix, multiset, shingle_hashes, word_hashes
from lodestone.plans.scratch import discard, materialise

REGISTERS, ROWS = 64, 4
#: Rows of a band and bands, by level; levels after the first hold only texts of buckets that stayed open.
LEVELS = ((ROWS, REGISTERS // ROWS), (8, 52), (12, 128))
THRESHOLD = 0.8
BLOCK, GUESTS, ROUNDS = 512, 512, 3
SHINGLES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 150_000
_STEP, _LAYER = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers per (shingles, counts); rows of empty bags are infinite."""
    table = np.full((len(bags), registers), np.inf)
    sizes = np.array([len(v) for v, _ in bags])
    if not sizes.sum():
        return table
    values = np.concatenate([v for v, _ in bags])
    counts = np.concatenate([c for _, c in bags]).astype(np.int64)
    docs = np.repeat(np.arange(len(bags)), sizes)
    seeds, rows, low, width, weight = [mix(values)], [docs], [np.zeros(len(values))], [np.ones(len(values))], [counts]
    layer = 1
    while (above := counts > 2 ** (layer - 1)).any():
        n = int(above.sum())
        seeds.append(mix(values[above] + mix(np.full(1, layer, dtype=np.uint64))))
        rows.append(docs[above])
        low.append(np.full(n, 2.0 ** (layer - 1)))
        width.append(np.full(n, 2.0 ** (layer - 1)))
        weight.append(counts[above])
        layer += 1
    seed, row, low, width, weight = (np.concatenate(x) for x in (seeds, rows, low, width, weight))
    at = np.zeros(len(seed))
    flat, step = table.reshape(-1), np.zeros(1, dtype=np.uint64)
    while len(seed):
        step = step + np.uint64(1)
        a = mix(seed + step * _STEP)
        b = mix(a ^ _LAYER)
        at = at - np.log(_unit(a)) / width
        live = at < table.max(axis=1)[row]
        seed, row, low, width, weight, at, b = (x[live] for x in (seed, row, low, width, weight, at, b))
        counted = np.ceil(low + width * _unit(mix(b))) <= weight
        np.minimum.at(flat, row[counted] * registers + (b[counted] % np.uint64(registers)).astype(np.int64), at[counted])
    return table


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    bits = table.view(np.uint64).reshape(len(table), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * _STEP + bits[:, :, i])
    return key.view(np.int64)


def _sign(batches):
    known = WordHashes()
    for b in batches:
        bags = []
        keys = np.empty(len(b), dtype=object)
        sizes = np.zeros(len(b), dtype=np.int64)
        order = b["text"].str.len().fillna(0).to_numpy().argsort(kind="stable")
        texts = b["text"].to_numpy()
        at, words = [], 0

        def flush():
            if at:
                found = band_keys(bag_signatures(bags))  # noqa: B023
                for j, i in enumerate(at):  # noqa: B023
                    keys[i] = found[j] if len(bags[j][0]) else None  # noqa: B023

        for i in order:
            if texts[i] is None:
                continue
            bag = multiset(shingle_hashes(word_hashes(texts[i], known)))
            bags.append(bag)
            sizes[i] = bag[1].sum()
            at.append(i)
            words += len(bag[0])
            if words >= WORDS_AT_ONCE:
                flush()
                bags, at, words = [], [], 0
        flush()
        yield pd.DataFrame({"doc_id": b["doc_id"], "h1": b["h1"], "h2": b["h2"], "no_text": b["no_text"], "size": sizes, "bands": pd.Series(keys, dtype=object)})


def _members(batches):
    known = WordHashes()
    for b in batches:
        yield pd.DataFrame({"node": b["node"], "bag": [as_set(*multiset(shingle_hashes(word_hashes(t, known)))).tobytes() for t in b["text"]]})


def forest(nodes: list[int], bags: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest (larger, smaller node) of the pairs whose set Jaccard similarity is at least ``threshold``."""
    n = len(nodes)
    sizes = np.array([len(x) for x in bags], dtype=np.int64)
    values, inverse, times = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), sizes)
    shared = times[inverse] > 1
    place = np.cumsum(times > 1) - 1
    column, doc = place[inverse[shared]], doc[shared]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    common = np.zeros((n, n), dtype=np.float32)
    width = max(1, 4_000_000 // n)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        x = np.zeros((n, width if j < len(column) else int(column[j - 1]) - a + 1), dtype=np.float32)
        x[doc[i:j], column[i:j] - a] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    near = np.triu(common >= threshold * union - 1e-6, 1)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, j in np.argwhere(near):
        p, q = find(i), find(j)
        if p != q:
            p, q = (p, q) if nodes[p] < nodes[q] else (q, p)
            root[q] = p
            out.append((nodes[q], nodes[p]))
    return out


def _link(threshold):
    """Links within each (bucket, block), whose rows arrive together."""

    def run(batches):
        key, members, found = None, {}, []

        def flush():
            if len(members) > 1:
                found.extend(forest([node for node, _ in members], list(members.values()), threshold))

        for b in batches:
            for k, x, node, bag in zip(b["bucket"], b["block"], b["node"], b["bag"], strict=True):
                if (k, x) != key:
                    flush()
                    key, members = (k, x), {}
                members[node, bag] = np.frombuffer(bag, dtype=np.uint64)
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found.clear()
        flush()
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _finer(level: int, rows: int, bands: int):
    """Bands of registers that no other level uses, from whole bags."""
    salt = mix(np.full(1, level, dtype=np.uint64))
    at_once = max(1, WORDS_AT_ONCE * REGISTERS // (rows * bands))

    def run(batches):
        for b in batches:
            values = [mix(np.frombuffer(bag, dtype=np.uint64) ^ salt) for bag in b["bag"]]
            upto = np.cumsum([len(v) for v in values]) // at_once
            for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(upto)) + 1):
                table = bag_signatures([(values[i], np.ones(len(values[i]), dtype=np.int64)) for i in part], rows * bands)
                yield pd.DataFrame({"node": b["node"].iloc[part], "size": [len(values[i]) for i in part], "bands": list(band_keys(table, rows))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for every node of the edges ``a, b``; stars alternate until only stars are left.

    The least neighbours are written before the join, so that it shuffles anew and the rows of a star's
    centre can be split.
    """
    least_of = lambda pairs: pairs.groupBy("u").agg(F.min("v").alias("m"))
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(least_of(both).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        down = least_of(large)
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct(), "edges")
        for done in (e, least, large):
            discard(done)
        e = after


def _buckets(banded: DataFrame) -> DataFrame:
    """``bucket, node`` of the buckets with two texts or more, one of those that hold the same texts."""
    sets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("n > 1")
    kept = materialise(sets.groupBy("n", "m", "x").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    return materialise(banded.join(kept, "bucket"), "members")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``bucket, node, size, label, top, others, blocks, room`` of the buckets of several classes.

    ``others`` counts members outside the largest class, ``top``; ``room`` is the number of guests that a block can take.
    """
    labelled = members.withColumn("label", F.col("node"))
    if roots is not None:
        labelled = members.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    labelled = materialise(labelled.select("bucket", "node", "size", "label"), "labelled")
    classes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    of_bucket = classes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("t"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(SHINGLES_AT_ONCE * F.col("n") / F.col("s"))))
    room = F.greatest(F.lit(1), F.least(F.lit(GUESTS), F.floor(SHINGLES_AT_ONCE * F.col("n") / F.col("s"))))
    state = of_bucket.select("bucket", F.col("t.label").alias("top"), (F.col("n") - F.col("t.c")).alias("others"), F.ceil(F.col("n") / per_block).cast("int").alias("blocks"), room.alias("room"))
    return materialise(labelled.join(materialise(state, "buckets"), "bucket"), "open")


def _guests(opened: DataFrame, salt: int) -> DataFrame:
    """``bucket, node, blocks``: the members that visit every block of a bucket of several blocks."""
    large = opened.filter("blocks > 1")
    few = large.filter("others <= room AND label <> top").select("bucket", "node", "blocks")
    order = F.xxhash64(F.lit(salt), "bucket", "node")
    drawn = large.filter("others > room").groupBy("bucket", "blocks", F.pmod(order, F.col("room")).alias("lane")).agg(F.min(F.struct(order.alias("o"), "node")).alias("g"))
    return few.unionByName(drawn.select("bucket", F.col("g.node").alias("node"), "blocks"))


def _roots(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame | None:
    """``node, root`` of every text with a link, from the members of the first level's buckets and their bags."""
    roots, salt = None, 0
    for level, (rows, bands) in enumerate(LEVELS):
        if level:
            finer = bags.join(nodes, "node", "left_semi").mapInPandas(_finer(level, rows, bands), "node long, size long, bands array<long>")  # noqa: F821
            members = _buckets(materialise(finer.select("node", "size", F.explode("bands").alias("bucket")).dropDuplicates(["node", "bucket"]), "bands"))
        turn = 0
        while level == len(LEVELS) - 1 or turn < ROUNDS:
            opened = _open(members, roots)
            if opened.isEmpty():
                return roots
            salt += 1
            turn += 1
            guests = materialise(_guests(opened, salt), "guests")
            block = F.pmod(F.xxhash64(F.lit(salt), "bucket", "node"), F.col("blocks")).cast("int")
            visits = guests.select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            dealt = materialise(opened.select("bucket", "node", block.alias("block")).unionByName(visits), "dealt")
            tasks = dealt.join(bags, "node").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
            links = tasks.mapInPandas(_link(threshold), "a long, b long")
            known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = materialise(components(known), "roots")
            # left to compare: members of buckets of several blocks that were not compared whole, but for the guests
            members = opened.filter("blocks > 1 AND others > room").join(guests.select("bucket", "node"), ["bucket", "node"], "left_anti").select("bucket", "node", "size")
        nodes = materialise(_open(members, roots).select("node").distinct(), "nodes")
        if nodes.isEmpty():
            break
    return roots


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, h1, h2`` for every row: the class is named by its least doc_id (h1, h2: hashes of the text)."""
    text = F.col("text")
    keyed = docs.select("doc_id", "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.isNull().alias("no_text"))
    signed = materialise(keyed.mapInPandas(_sign, "doc_id long, h1 long, h2 long, no_text boolean, size long, bands array<long>"), "signatures")
    texts = signed.filter("bands IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size")).filter("node IS NOT NULL")
    members = _buckets(materialise(texts.select("node", "size", F.explode("bands").alias("bucket")), "bands"))
    wanted = members.select("node").distinct()
    whole = docs.select(F.col("doc_id").alias("node"), "text").filter("text IS NOT NULL")
    bags = materialise(whole.join(wanted.hint("shuffle_hash"), "node").mapInPandas(_members, "node long, bag binary"), "bags")
    roots = _roots(members, bags, threshold)
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    named = texts.select("h1", "h2", "node").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("found"))
    bare = signed.filter("bands IS NULL AND NOT no_text").groupBy("h1", "h2").agg(F.min("doc_id").alias("found"))
    # written, so that the join shuffles anew and the rows of very many copies can be split
    class_of = materialise(named.unionByName(bare), "classes")
    held = signed.filter("NOT no_text").select("doc_id", "h1", "h2").join(class_of, ["h1", "h2"], "left").select("doc_id", F.col("found").alias("class_id"), "h1", "h2")
    return held.unionByName(signed.filter("no_text").select("doc_id", F.col("doc_id").alias("class_id"), "h1", "h2"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without later near copies: of each class the one with the least doc_id stays, once.

    Rows that agree in doc_id and text are one document; every row of null text stays.
    """
    names = docs.columns
    hidden = [f"c{i}" for i in range(len(names))]
    bare = docs.toDF(*hidden)
    key, text = (F.col(hidden[names.index(n)]) for n in ("doc_id", "text"))
    ids = bare.select(key.alias("doc_id"), text.alias("text"))
    stays = near_duplicate_classes(ids, threshold).filter("doc_id = class_id OR class_id IS NULL").select(F.col("doc_id").alias("d"), "h1", "h2").distinct()
    alone = F.when(text.isNull(), F.monotonically_increasing_id())
    keyed = bare.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text), "alone": alone})
    joined = keyed.join(stays.hint("shuffle_hash"), key.eqNullSafe(F.col("d")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
    return joined.dropDuplicates(["d", "k1", "k2", "alone"]).select(*hidden).toDF(*names)
