import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, licenses, line_dedup, mixing, near_dedup, quality, queries, rules, sharding, warc
from lodestone.llm.shingles import WordHashes, as_set, multiset, shingle_hashes, word_hashes
from lodestone.plans.scratch import materialise

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))
SHARED = "\n".join(" ".join(f"s{i}w{j}" for j in range(20)) for i in range(4))
#: Nulls everywhere, empty and very long texts, repeated rows, ties, and extra columns with clashing names.
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n ", "en", None), (4, LONG, "en", "a"), (5, LONG + " tail", "en", "b"),
    (6, "one two three", "de", "b"), (6, "one two three", "de", "b"), (7, "one two three", None, None), (None, "one two three", "en", "a"),
    (8, SHARED + "\nown line here", "en", "a"), (9, "first\n" + SHARED, "en", "c"), (10, "a " * 200, "en", "c"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "x", 2, "y", 3) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key string, shard int, h1 string, score int").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in expected.description]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in cols) for r in found.collect()) == sorted(tuple(map(show, r)) for r in expected.fetchall())


def test_rules_on_odd_rows(odd, none):
    got = rules.apply_policy(rules.ledger(odd)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].base_failed and by[4].n_words == 30_000 and by[4].kept
    assert by[10].n_repeat_words == 200 and by[10].base_failed
    assert rules.ledger(none).count() == 0
    assert {r.rule: r.fails for r in rules.ablation(rules.ledger(odd)).collect()}["too_few_words"] == 8
    assert rules.quality_filter(odd).columns == odd.columns
    stored = rules.store_ledger(odd)
    kept = {v: rules.apply_policy(stored, v).filter("kept").count() for v in rules.POLICIES}
    assert kept["v2"] <= kept["v1"] <= kept["base"] and rules.quality_filter(odd, "v2").count() == kept["v2"]
    assert {r.rule: r.fails for r in rules.ablation(stored, "length_only").collect()} == {"too_few_words": 8, "very_long": 0}


def test_mixing(odd, none):
    mix = mixing.Mix(odd, block_tokens=64)
    rows = mix.taken().collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    per = defaultdict(int)
    for r in rows:
        per[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) < 1 for (_, target), taken in per.items())
    again = mixing.Mix(odd.repartition(5), block_tokens=64).taken().collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.Mix(none).taken().count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(none).count() == 0
    assert mixing.targets([10, 100], [3, 1], 60, 2) == [20, 40]


def test_schedule_is_low_discrepancy(odd, monkeypatch):
    """Every prefix of slots holds each source in proportion, ranks count up in slot order, and passes follow the slots."""
    monkeypatch.setattr(mixing, "SLOTS_PER_CHUNK", 50)
    mix = mixing.Mix(odd, block_tokens=64)
    rows = sorted(map(tuple, mix.schedule().collect()))
    slots, counts = mix.slot_counts()
    assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) == sum(counts) and slots > 500
    seen = Counter()
    for slot, skey, rank in rows:
        assert rank == seen[skey]
        seen[skey] += 1
        if slot < slots:
            assert all(abs(seen[i] - (slot + 1) * t / sum(mix.tokens)) < 6 for i, t in enumerate(mix.tokens))
    assert seen == Counter({i: c for i, c in enumerate(counts) if c})
    for n, edge in ((0, 5), (1, 0), (1, 1), (700, mixing.TURN // 3), (700, mixing.TURN)):
        assert mixing.points_below(n, edge) == sum(i * mixing.GOLDEN % mixing.TURN < edge for i in range(n))
    places = sorted((r.slot, r.start, r.epoch, r.doc_id) for r in mix.spans().groupBy("skey", "doc_id", "start", "epoch").agg(F.min("slot").alias("slot")).collect())
    taken = mixing.mix_documents(odd, block_tokens=64).collect()
    assert [p[3] for p in places] == [r.doc_id for r in taken] and len(taken) > len(ODD) // 2
    assert all(p.first + p.size >= p.last for p in mix.spans().collect())


def _least_capacity(sizes, shards):
    best = None
    for c in range(max(sizes), sum(sizes) + 1):
        used, at = 1, 0
        for s in sizes:
            if at + s > c:
                used, at = used + 1, 0
            at += s
        if used <= shards:
            best = c
            break
    return best


def test_minimax_cuts(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        keys = np.sort(rng.choice(1 << 60, 60, replace=False))
        sizes = rng.integers(1, 50, 60)
        df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, size long")
        cuts, capacity = sharding.minimax_cuts(df, "key", "size", 5)
        assert capacity == _least_capacity(sizes.tolist(), 5)
        shard = np.searchsorted(cuts, keys, side="right")
        assert max(sizes[shard == s].sum() for s in range(5)) == capacity


def test_sharding_odd_rows(odd, none):
    rows = sharding.shard_documents(odd).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(ODD) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"one two three")}) == 1
    assert sharding.shard_documents(none).count() == 0


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        a = dict(zip(rng.integers(0, 60, 40).tolist(), rng.integers(1, 9, 40).tolist(), strict=True))
        b = {k: v for k, v in a.items() if rng.random() < 0.8} | {int(k): 2 for k in rng.integers(0, 60, 6)}
        bags = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        s = near_dedup.bag_signatures(bags, 256)
        keys = set(a) | set(b)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def _brute_classes(rows, threshold=0.8):
    known = WordHashes()
    bags = [(d, as_set(*multiset(shingle_hashes(word_hashes(t, known))))) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            common = len(np.intersect1d(x, y))
            if (len(x) and common >= threshold * (len(x) + len(y) - common)) or (len(x) == len(y) == 0 and dict(rows)[a] == dict(rows)[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for k in range(int(rng.integers(1, 30))):
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(0, 150))] = f"x{rng.integers(0, 99)}"
            rows.append((n, " ".join(words)))
            n += 1
            if k % 3 == 0:
                rows.append((n, rows[-1][1]))
                n += 1
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == _brute_classes(rows)


def test_near_duplicates_in_buckets_of_many_blocks(spark, monkeypatch):
    """Blocks far smaller than the groups, which hold copies, near copies, chains and texts that merely resemble each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "GUESTS", 3)
    monkeypatch.setattr(near_dedup, "ROUNDS", 2)
    rng = np.random.default_rng(11)
    rows = []
    for g, (size, changes) in enumerate(((40, 2), (40, 12))):
        base = [f"g{g}w{x}" for x in range(200)]
        for _ in range(size):
            words = list(base)
            for at in rng.integers(0, 200, changes):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    chain = [f"c{x}" for x in range(200)]
    for k in range(30):
        rows.append((len(rows), " ".join(chain)))
        chain[7 * k % 200] = f"y{k}"
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == _brute_classes(rows)


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == 1 and by[2] == 2 and by[5] == 4 and by[7] == by[6] == 6
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 8, 10, None])
    assert near_dedup.near_duplicate_classes(none).count() == 0
    twice = odd.select("doc_id", "text", F.lit(1).alias("a.b"), F.lit(2).alias("TEXT.x"))
    nulls = twice.filter("text IS NULL")
    assert near_dedup.keep_one(nulls.unionByName(nulls)).count() == 4 and near_dedup.keep_one(twice).columns == twice.columns


def test_decontamination(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    items = [(r.item_id, " " + " ".join(decontam.tokens(r.text)) + " ") for r in bench.collect()]
    expected = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " " + " ".join(decontam.tokens(r.text)) + " "}
    assert expected <= got
    rare = spark.createDataFrame([(1, "quartz jumbled vexing waltz nymph for quick jigs beneath old copper gates"), (2, None), (None, "x y z v w u")], "item_id long, text string")
    para = "so then quartz jumbled really vexing waltz nymph for quick jigs beneath copper gates ended"
    extra = spark.createDataFrame([(70, para)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(extra)
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(both, rare).collect()] == [(70, 1)]
    left = decontam.decontaminate(both, rare)
    assert left.count() == len(ODD) and left.filter("doc_id = 70").isEmpty()
    assert decontam.contaminated(none, rare).count() == 0
    assert decontam.contaminated(both, rare.filter("false")).count() == 0


def test_decontamination_with_many_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: decontam.tokens(r.text) for r in docs.collect()}
    rng, spans, changed = np.random.default_rng(6), {}, {}
    long = [d for d, w in sorted(texts.items()) if len(w) >= 60]
    for i in range(1000):
        w = texts[long[int(rng.integers(len(long)))]]
        at = int(rng.integers(len(w) - 14))
        spans[i] = w[at : at + 14]
        changed[i] = [x for j, x in enumerate(spans[i]) if j != 3] + ["inserted"]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in spans.items()], "item_id long, text string")
    extra = spark.createDataFrame([(-1 - i, " ".join(w)) for i, w in changed.items()], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench).select("doc_id", "item_id").collect()}
    held = {d: " " + " ".join(w) + " " for d, w in texts.items()}
    expected = {(d, i) for i, w in spans.items() for d, t in held.items() if " " + " ".join(w) + " " in t}
    assert len(expected) >= 1000 and not expected - got
    assert not {(-1 - i, i) for i in spans} - got


def test_singular_vectors():
    """Those of a matrix of known rank, from its product with the sign matrix alone."""
    rng = np.random.default_rng(9)
    basis = np.linalg.qr(rng.standard_normal((decontam.BUCKETS, 6)))[0]
    values = np.array([50.0, 30, 20, 10, 5, 1])
    where, sign = decontam._signs(24)
    r = np.zeros((decontam.BUCKETS, 24))
    r[np.arange(decontam.BUCKETS)[:, None], where] = sign
    vectors, found = decontam.singular_vectors(basis * values**2 @ (basis.T @ r), 24, 6)
    assert np.allclose(found, values, rtol=1e-2) and np.allclose(np.abs((vectors * basis).sum(axis=0)), 1, atol=1e-3)


def test_rows_are_added_at_repeated_places(monkeypatch):
    rng = np.random.default_rng(10)
    for rounds in (1, 24):
        monkeypatch.setattr(decontam, "ROUNDS", rounds)
        index, take = rng.integers(0, 9, 400), rng.integers(0, 30, 400)
        source, got, expected = rng.standard_normal((30, 5)), np.zeros((9, 5)), np.zeros((9, 5))
        decontam._add_rows(got, index, source, take)
        np.add.at(expected, index, source[take])
        assert np.allclose(got, expected)


def test_decontamination_of_paraphrases(spark):
    """Items cut from documents, reworded: a share of words replaced by others of the corpus, neighbours swapped, words inserted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [decontam.tokens(r.text) for r in docs.orderBy("doc_id", "text").collect()]
    long = [w for w in texts if len(w) >= 60]
    words = sorted({x for w in long for x in w})
    rng, items, reworded = np.random.default_rng(12), [], []
    for i in range(300):
        w = long[int(rng.integers(len(long)))]
        at = int(rng.integers(len(w) - 24))
        items.append((i, " ".join(w[at : at + 24])))
        out = [words[int(rng.integers(len(words)))] if rng.random() < 0.15 else x for x in w[at : at + 24]]
        j = int(rng.integers(20))
        out[j : j + 2] = out[j : j + 2][::-1]
        out[j : j + 1] = [out[j], "inserted"]
        reworded.append((-1 - i, " ".join([*words[:20], *out, *words[20:40]])))
    clean = [(-1000 - i, " ".join(words[int(x)] for x in rng.integers(0, len(words), 80))) for i in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    both = docs.unionByName(spark.createDataFrame(reworded + clean, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench).filter("doc_id < 0").collect()}
    right = {(d, i) for d, i in got if texts_equal(items[i][1], items[-1 - d][1])} if all(d >= -300 for d, _ in got) else set()
    assert len({d for d, _ in right}) >= 0.9 * 300 and len(right) >= 0.98 * len(got)


def texts_equal(a: str, b: str) -> bool:
    """Whether two items share most of their words, as those cut from copies or overlapping places do."""
    return len(set(a.split()) & set(b.split())) >= 0.5 * len(set(a.split()))


def test_decontamination_in_small_blocks_and_of_short_items(spark, monkeypatch):
    rows = [(1, "zwölf uhr mitternacht"), (2, "a b"), (3, "機械学習の評価問題集です東京"), (4, "quartz jumbled vexing waltz nymph for quick jigs beneath old copper gates"), (5, None)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    texts = [(10, "es war zwölf uhr, mitternacht"), (11, "mitternacht zwölf uhr"), (12, "a b"), (13, "これは機械学習の評価問題集です東京から"), (14, "x " * 5000 + rows[3][1] + " y" * 5000), (15, "uhr mitternacht zwölf")]
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string")
    expected = [(10, 1), (13, 3), (14, 4)]
    space = decontam.fit(decontam.tokenised(docs), rank=8)
    (segs,) = decontam.segments(bench)
    known = decontam.TokenHashes()
    monkeypatch.setattr(decontam, "CELLS_AT_ONCE", 3)
    found = decontam.Scanner(decontam.prepare(segs, space)).find(decontam.Tokens.of([decontam.token_hashes(t, known) for _, t in texts]))
    assert sorted((texts[r][0], i) for r, i, _, _ in found) == expected
    for size in (200_000, 3):
        monkeypatch.setattr(decontam, "BLOCK_TOKENS", size)
        assert len(list(decontam.segments(bench))) == (1 if size > 3 else 3)
        assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == expected
        assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [11, 12, 15]


def test_decontamination_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 4000)]
    items = [(i, word(int(rng.integers(5, 50))), word(2) if i % 3 == 0 else None) for i in range(150)]
    docs = []
    for d in range(120):
        words = word(150)
        w = items[d][1]
        at, kept = int(rng.integers(100)), [x for x in w if rng.random() < 0.85]
        docs.append((d, words[:at] + kept + words[at:]))
    bench = spark.createDataFrame([(i, " ".join(w), a and " ".join(a)) for i, w, a in items], "item_id long, text string, answer string")
    (segs,) = decontam.segments(bench, "answer")
    assert all(a is None for x in decontam.segments(bench) for a in x.answers)
    space = decontam.fit(decontam.tokenised(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")), rank=8)
    scanner, known = decontam.Scanner(decontam.prepare(segs, space)), decontam.TokenHashes()
    ids, expected = [decontam.token_hashes(" ".join(w), known) for _, w in docs], set()
    for d, words in enumerate(ids):
        for a in range(0, len(words), decontam.CELL):
            passage = words[a : a + 2 * decontam.CELL]
            x = space.terms[decontam.bucket_of(passage)].sum(axis=0)
            cosine = scanner.m.items @ (x / max(np.linalg.norm(x), 1e-12))
            expected |= {(d, segs.item[s]) for s in range(len(segs.ids)) if scanner.accept(s, passage.tolist(), set(passage.tolist()), cosine[s] if cosine[s] >= decontam.COSINE else 0)}
    decontam_pairs, decontam.PAIRS_AT_ONCE = decontam.PAIRS_AT_ONCE, 10
    try:
        assert {(r, i) for r, i, _, _ in scanner.find(decontam.Tokens.of(ids))} == expected
    finally:
        decontam.PAIRS_AT_ONCE = decontam_pairs


def test_subsequence_against_dynamic_programme():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 6, 20).tolist(), rng.integers(0, 6, 40).tolist()
        t = np.zeros((21, 41), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = defaultdict(int)
        for i, x in enumerate(a):
            masks[x] |= 1 << i
        assert decontam.subsequence(masks, 20, b) == t[20, 40]


def test_language(spark, odd, none):
    found = queries.op1_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.9
    learnt = langid.learn(odd, F.col("doc_id").isNotNull())
    rows = langid.identify(odd, learnt).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.learn(none, F.lit(True)) == {} and langid.identify(odd, {}).filter("lang_pred <> 'und'").isEmpty()


def test_op1_matches_brute_force(spark):
    """Every text against every dictionary, piece by piece, with nothing but the compressor."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = langid.learn(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    packers = {n: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for n, d in learnt.items()}
    got = queries.op1_langid(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.held_out for r in got) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in texts)
    for r in got:
        data = re.sub(r"[\W\d_]+", " ", (texts[r.doc_id] or "").lower()).encode()
        if not data.strip():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = sorted((sum(len(p.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), n) for n, p in packers.items())
        margin = sizes[1][0] / sizes[0][0] - 1
        assert r.lang_pred == sizes[0][1] and r.rejected == (margin < 0.01) and abs(r.score - margin / (margin + 0.02)) < 1e-9


def test_risk_on_dense_arrays(monkeypatch):
    """The fit equals plain gradient steps on the risk formula over an explicit matrix of indicators."""
    monkeypatch.setattr(quality, "STEPS", 40)
    rng = np.random.default_rng(5)
    x, p, prior = rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) + 1, 0.4
    model = quality.fit(p, x, prior)
    wide = lambda a: np.concatenate([(a[:, [i]] > c[None, :]).astype(float) for i, c in enumerate(model.cuts)], axis=1)
    xp, xu = wide(p), wide(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    theta, m, v, kinds = np.zeros(xp.shape[1] + 1), 0, 0, set()
    xp1, xu1 = np.c_[xp, np.ones(len(xp))], np.c_[xu, np.ones(len(xu))]
    for step in range(1, 41):
        zp, zu = xp1 @ theta, xu1 @ theta
        negative = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        down = (xu1 * sigmoid(zu)[:, None]).mean(0) - prior * (xp1 * sigmoid(zp)[:, None]).mean(0)
        g = prior * (xp1 * (sigmoid(zp) - 1)[:, None]).mean(0) + down if negative >= 0 else -down
        kinds.add(negative >= 0)
        g[:-1] += quality.DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - quality.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weights, theta[:-1]) and abs(model.bias - theta[-1]) < 1e-9 and True in kinds
    assert np.allclose(model.score(x), sigmoid(xu1 @ theta))


def test_prior_follows_a_skewed_label_set(spark):
    """Labels that are no random sample move the prior to their own share; without a 0 it comes from the texts alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL").join(docs.select("doc_id"), "doc_id")
    few = labels.filter("quality = 1").orderBy("doc_id").limit(5).unionByName(labels.filter("quality = 0")).select("doc_id", "quality")
    n = few.count()
    assert abs(quality.train(docs, few, F.lit(True)).prior - 6 / (n + 2)) < 1e-9
    assert 0.02 <= quality.train(docs, labels.filter("quality = 1").select("doc_id", "quality"), F.lit(True)).prior <= 0.98


def test_quality(spark, odd, none):
    found = queries.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    labels = spark.createDataFrame([(4, 1), (8, 1), (9, 1), (4, 0), (None, 1), (10, None)], "doc_id long, quality int")
    model = quality.train(odd, labels, F.lit(True))
    assert len(quality.score(odd, model).collect()) == len(ODD)
    assert quality.train(none, labels, F.lit(True)) is None
    assert quality.score(odd, None).filter("predicted <> 0").isEmpty()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2)) + np.where(rng.random(3000) < 0.6, 3, -3)[:, None]
    p = rng.normal(size=(800, 2)) + 3
    assert abs(quality.fit(p, x, None).prior - 0.6) < 0.12


def test_quality_keeps_few_labels(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    few = labels.filter("quality = 1").orderBy("doc_id").limit(7).unionByName(labels.filter("quality = 0").orderBy("doc_id").limit(4)).select("doc_id", "quality")
    given = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: given.append((len(p), len(u), prior)))
    quality.train(docs, few, F.lit(True), sample_docs=60)
    ((positives, unlabelled, prior),) = given
    assert positives == 7 and 30 < unlabelled < 100 and prior == 8 / 13


def test_licenses(odd, none, spark):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "x " * 500 + licenses.TEMPLATES["MIT"] + " y" * 500), (51, "Licensed under the Apache License, Version 2.0."), (52, "licensed under moonlight")], "doc_id long, text string"))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(50, "MIT"), (51, "Apache-2.0 notice")}
    assert licenses.scan_licenses(none).count() == 0


def test_whole_licenses_as_templates(spark):
    """Templates of several thousand words, found whole, edited and cut short in longer texts."""
    rng = np.random.default_rng(8)
    long = {f"license {n}": " ".join(f"l{n}w{x}" for x in rng.integers(0, 900, n)) for n in (1600, 5600)}
    words = {n: t.split() for n, t in long.items()}
    few = {n: " ".join("edit" if i % 60 == 0 else w for i, w in enumerate(ws)) for n, ws in words.items()}
    many = {n: " ".join("edit" if i % 15 == 0 else w for i, w in enumerate(ws)) for n, ws in words.items()}
    half = {n: " ".join(ws[: len(ws) // 2]) for n, ws in words.items()}
    pad = "own words before " * 700
    rows = [(i, pad + t + " and after" * 900) for i, t in enumerate([*long.values(), *few.values(), *many.values(), *half.values(), ""])]
    got = sorted((r.doc_id, r.license, r.containment) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), long | {"MIT": licenses.TEMPLATES["MIT"]}).collect())
    names = list(long)
    assert [(d, n) for d, n, _ in got] == [(0, names[0]), (1, names[1]), (2, names[0]), (3, names[1])]
    assert [c for _, _, c in got[:2]] == [1.0, 1.0] and all(0.8 <= c < 1 for _, _, c in got[2:])
    assert licenses.window_classes(5596) == [4, 16, 64, 256, 1024, 4096, 16384]


def test_licenses_near_each_other(spark):
    edited = licenses.TEMPLATES["Apache-2.0 header"].replace("agreed to in writing", "settled in writing")
    mit = "Released under the MIT License."
    three, two = licenses.TEMPLATES["GPL-3.0 notice"], licenses.TEMPLATES["GPL-2.0 notice"].removeprefix("This ")
    texts = [f"{edited} some words {mit}", f"{mit} {edited}", edited, three, f"{three} {'x ' * 300}{two}"]
    apache = {"Apache-2.0 header", "Apache-2.0 notice"}
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = [{r.license for r in got if r.doc_id == i} for i in range(len(texts))]
    assert found == [apache | {"MIT notice"}, apache | {"MIT notice"}, apache, {"GPL-3.0 notice"}, {"GPL-3.0 notice", "GPL-2.0 notice"}]
    assert len(got) == sum(map(len, found)) and 0.8 <= min(r.containment for r in got if r.license == "Apache-2.0 header") < 1


def _brute_lines(rows, least=50):
    """Every run of lines with enough words, of any length, that stands elsewhere earlier, goes; common prefixes of all pairs by dynamic programming."""
    worded = []
    for d, t in rows:
        worded.append((d, [(i, x.strip(line_dedup.SPACES)) for i, x in enumerate(t.split("\n")) if x.strip(line_dedup.SPACES)]))
    gone = defaultdict(set)
    for b, (d, own) in enumerate(worded):
        size = [len(x.split()) for _, x in own]
        for e, (doc, other) in enumerate(worded[: b + 1]):
            common = np.zeros((len(own) + 1, len(other) + 1), dtype=int)
            for i in range(len(own) - 1, -1, -1):
                for j in range(len(other) - 1, -1, -1):
                    if own[i][1] == other[j][1] and (e < b or j < i):
                        common[i, j] = common[i + 1, j + 1] + 1
            for i, j in zip(*np.nonzero(common), strict=True):
                words = 0
                for n in range(1, common[i, j] + 1):
                    words += size[i + n - 1]
                    if words >= least:
                        gone[d].update(own[x][0] for x in range(max(i, j + n) if e == b else i, i + n))
    return {d: x for d, x in gone.items() if x}


def test_lines_to_the_end_of_a_run(spark):
    """Ends of a run that are too short for a window of their own, and a first copy that is shorter than a second."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    long = [line("a", 200), *[line(f"b{k}_", 4) for k in range(12)]]
    short = [line("c", 45), line("d", 5), "e", "f", "g"]
    grown = [line("h", 30), line("i", 30), line("j", 3), line("k", 3)]
    rows = [(0, "\n".join(long)), (1, "\n".join(["own", *long, "mine"])), (2, "\n".join(short)), (3, "\n".join([*short, "x"])), (4, "\n".join(grown[:2])), (5, "\n".join(grown)), (6, "\n".join(grown))]
    got = {r.doc_id: r for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: set(r.removed) for d, r in got.items()} == _brute_lines(rows) == {1: set(range(1, 14)), 3: set(range(5)), 5: {0, 1}, 6: {0, 1, 2, 3}}
    assert [(r.line, r.lines, r.first_doc_id) for r in got[1].runs] == [(1, 13, 0)] and [(r.line, r.lines) for r in got[3].runs] == [(0, 5)]
    assert got[3].removed_words == 53 and {(r.line, r.lines, r.first_doc_id) for r in got[6].runs} >= {(0, 2, 4)}


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(n))) for n in rng.integers(1, 20, 40)]
    rows = []
    for d in range(60):
        at = int(rng.integers(0, 30))
        lines = pool[at : at + int(rng.integers(2, 12))] + [f"own {d} {x}" for x in range(3)]
        rows.append((d, "\n".join(lines + [""] + pool[:2])))
    got = line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: set(r.removed) for r in got} == _brute_lines(rows)
    texts = {d: t.split("\n") for d, t in rows}
    worded = lambda d, at: [x for x in texts[d][at:] if x.strip()]
    for r in got:
        for run in r.runs:
            own, first = worded(r.doc_id, run.line)[: run.lines], worded(run.first_doc_id, run.first_line)[: run.lines]
            assert own == first and sum(len(x.split()) for x in own) >= 50 and set(r.first_doc_ids) >= {run.first_doc_id}


def test_lines_that_overlap_themselves(spark):
    ten = " ".join(f"t{i}" for i in range(10))
    pair = [" ".join(f"{c}{i}" for i in range(13)) for c in "ab"]
    rows = [(0, "\n".join([ten] * 6)), (1, "\n".join([ten] * 3)), (2, "\n".join([ten] * 12)), (3, "\n".join(pair * 5)), (4, "\n".join([*pair * 2, "own"]))]
    got = {r.doc_id: r.removed for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: sorted(x) for d, x in _brute_lines(rows).items()}
    assert got[0] == [5] and got[2] == list(range(12)) and 1 not in got and got[3] == [4, 5, 6, 7, 8, 9] and got[4] == [0, 1, 2, 3]


def test_lines_whose_hashes_clash(spark, monkeypatch):
    """Lines that share an id by accident are not deleted."""
    monkeypatch.setattr(line_dedup, "line_id", lambda line: F.pmod(F.xxhash64(line), F.lit(3)))
    rows = [(d, "\n".join(" ".join(f"d{d}l{k}w{i}" for i in range(20)) for k in range(8))) for d in range(12)]
    assert line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_lines_odd_rows(odd, none):
    got = {r.doc_id: (r.removed, r.first_doc_ids) for r in line_dedup.removals(odd).collect()}
    assert got == {9: ([1, 2, 3, 4], [8])}
    cleaned = line_dedup.dedup_lines(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ODD)
    assert cleaned.filter("doc_id = 9").first().text == "first"
    assert line_dedup.removals(none).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    pages = spark.createDataFrame([(1, "http://a\r\nb", body, 9), (2, None, body, 9), (3, "u", "small", 9), (4, "v", "small", 9), (5, "w", None, 9), (None, "n", body, 9), (2, None, body, 9)], "page_id long, url string, html string, payload int").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    rows = warc.page_table(warc.read_warc(spark, path)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter({(1, "revisit", 2): 1, (2, "response", None): 2, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "revisit", 2): 1})
    assert {r.payload_bytes for r in rows} == {len(body.encode()), 5, 0}
    digest = hashlib.sha1(body.encode()).hexdigest()
    some = warc.read_warc(spark, path).filter(f"record_type = 'revisit' AND record_id IN ('urn:page:1:{digest}', 'urn:page:9')")
    assert [r.target_uri for r in some.collect()] == ["http://a  b"]
    assert warc.read_warc(spark, path, payload=False).filter("payload IS NOT NULL").isEmpty()
    warc.write_warc(pages.coalesce(1), f"{tmp_path}/small", file_bytes=200)
    assert len(list((tmp_path / "small").glob("*.warc.gz"))) > 2 and warc.read_warc(spark, f"{tmp_path}/small").count() == 7
    warc.write_warc(pages.filter("false"), f"{path}2")
    assert warc.read_warc(spark, f"{path}2").count() == 0
    assert warc.read_warc(spark, [path, f"{path}2", path]).count() == 2 * len(rows)


def _record(uri: str, http: bytes, body: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("kind", ["plain", "members", "one", "own"])
def test_warc_foreign_archives(spark, tmp_path, kind):
    """Archives of others, with long payloads, encoded bodies and headers that cannot be read."""
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    parts = [
        _record("a", b"Content-Length: 300000", noise), b"WARC/1.0\r\nWARC-Type: response\r\nno length here\r\n\r\nlost text\r\n\r\n",
        _record("b", b"Transfer-Encoding: chunked", chunked), b"noise between\r\n", _record("c", b"Content-Encoding: gzip", gzip.compress(b"packed")), _record("d", b"X: y", b""),
    ]
    data = {"plain": b"".join, "one": lambda p: gzip.compress(b"".join(p)), "members": lambda p: b"".join(map(gzip.compress, p)), "own": lambda p: b"".join(map(warc.member, p))}[kind](parts)
    (tmp_path / "x.warc").write_bytes(data)
    read = lambda **o: warc.read_warc(spark, str(tmp_path / "x.warc"), **o)
    got = {r.target_uri: bytes(r.payload) for r in read().collect()}
    assert got == {"a": noise, "b": chunked, "c": got["c"], "d": b""} and gzip.decompress(got["c"]) == b"packed"
    decoded = {r.target_uri: bytes(r.payload) for r in read(decode=True).collect()}
    assert decoded["b"] == b"hello world" and decoded["c"] == b"packed" and decoded["a"] == noise
    assert [r.target_uri for r in read().filter("target_uri = 'd'").collect()] == ["d"]
    assert [r.target_uri for r in read(payload=False).collect()] == ["a", "b", "c", "d"]
    gaps = spark.read.format("warc").option("malformed", "true").load(str(tmp_path / "x.warc")).filter("record_type = 'malformed'").collect()
    assert len(gaps) >= 2 and all(r.http_length > 0 for r in gaps)


def _md5_key(*parts) -> int:
    return int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def _brute_items(spark, docs, items) -> set[tuple]:
    """(document, item) pairs whose item's tokens a passage holds well enough, by comparing every passage with every segment."""
    known, found = decontam.TokenHashes(), set()
    (segs,) = decontam.segments(items)
    space = decontam.fit(decontam.tokenised(spark.createDataFrame(docs, "doc_id long, text string")), rank=8)
    scanner = decontam.Scanner(decontam.prepare(segs, space))
    for d, t in docs:
        ids = decontam.token_hashes(t, known).tolist()
        for a in range(0, len(ids), decontam.CELL):
            passage = ids[a : a + 2 * decontam.CELL]
            here = set(passage)
            found |= {(d, segs.item[s]) for s in range(len(segs.ids)) if len(scanner.sets[s] & here) >= 0.4 * len(scanner.sets[s]) and scanner.accept(s, passage, here, 0.0)}
    return found


def test_op4_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in _table(spark, "documents").collect()}
    rows = queries.op4_sharding(spark, SF).collect()
    size = {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (size[d], zlib.crc32(t.encode())) for d, t in texts.items()}
    groups, shards = defaultdict(int), defaultdict(set)
    for r in rows:
        key = _md5_key(str(texts[r.doc_id] is None).lower(), texts[r.doc_id])
        groups[key] += r.size
        shards[key].add(r.shard)
    order = sorted(groups)
    of = [min(shards[k]) for k in order]
    assert all(len(v) == 1 for v in shards.values()) and of == sorted(of)
    filled = Counter()
    for r in rows:
        filled[r.shard] += r.size
    assert max(filled.values()) == _least_capacity([groups[k] for k in order], 8)
    for shard in filled:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_op6_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in _table(spark, "documents").collect()]
    got = {(r.doc_id, r.item_id): r.matched for r in queries.op6_decontamination(spark, SF).collect()}
    expected = _brute_items(spark, docs, _table(spark, "benchmark"))
    assert expected and expected <= set(got)
    assert all(got[pair] >= decontam.NEAR for pair in set(got) - expected) and len(got) <= 1.02 * len(expected) + 1


def test_op7_query_against_brute_force(spark):
    """A template is found in a document if some run of twice its class holds 80% of its shingles."""
    known = WordHashes()
    wanted = {n: set(licenses.shingles(t, known).tolist()) for n, t in licenses.TEMPLATES.items()}
    expected = set()
    for r in _table(spark, "documents").collect():
        found = licenses.shingles(r.text, known).tolist()
        for name, parts in wanted.items():
            at = [i for i, s in enumerate(found) if s in parts]
            span = 2 * min(c for c in licenses.CLASSES if c >= len(parts))
            if any(len({found[j] for j in at if i <= j < i + span}) >= licenses.CONTAINED * len(parts) for i in at):
                expected.add((r.doc_id, name))
    got = {(r.doc_id, r.license) for r in queries.op7_license_scan(spark, SF).collect()}
    assert got <= expected and {d for d, _ in got} == {d for d, _ in expected} and got


def test_op8_op9_queries_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in _table(spark, "documents").collect() if r.text is not None)
    lines = {r.doc_id: set(r.removed) for r in queries.op8_line_dedup(spark, SF).collect()}
    assert lines == _brute_lines(rows) and lines
    classes = {r.doc_id: r.class_id for r in queries.op9_near_dedup(spark, SF).collect()}
    expected = _brute_classes(rows)
    assert {d: classes[d] for d, _ in rows} == expected and len(set(expected.values())) < len(rows)


def test_pipeline_against_brute_force(spark):
    """Every stage again, row by row: rules from their SQL, copies and items by all pairs, the mix by running sums."""
    import corpus_pipeline

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    texts = {r.doc_id: (r.text, r.source) for r in _table(spark, "documents").collect()}
    kept = [r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op5_quality_rules']}) WHERE kept").fetchall()]
    classes = _brute_classes([(d, texts[d][0]) for d in kept])
    left = [d for d in kept if classes[d] == d]
    held = {d for d, _ in _brute_items(spark, [(d, texts[d][0]) for d in left], _table(spark, "benchmark"))}
    left = [d for d in left if d not in held]
    words = {d: len([w for w in re.split("[ \t\n\x0b\f\r]+", texts[d][0]) if w]) for d in left}
    names = sorted({texts[d][1] for d in left}, key=lambda n: (n is None, n or ""))
    sizes = [sum(words[d] for d in left if texts[d][1] == n) for n in names]
    goals = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    expected = Counter()
    for n, size, goal in zip(names, sizes, goals, strict=True):
        at, passes, rest = 0, int(goal) // size, int(goal) % size
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        for d in sorted((d for d in left if texts[d][1] == n and words[d]), key=lambda d: _md5_key(42, d, md5(texts[d][0]))):
            expected[d] += passes + (at < rest)
            at += words[d]
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == +expected
    assert all(r.size == len(texts[r.doc_id][0].encode()) + 1 for r in out) and {r.shard for r in out} == set(range(8))


def test_pipeline_keeps_the_order_of_the_mix(spark):
    """Each shard holds its documents in the order of the mix's slots."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = [r.doc_id for r in mixing.mix_documents(docs).select("doc_id").collect()]
    mixed = materialise(corpus_pipeline.mixing(spark, docs, SF), "mixed")
    assert mixed.columns == docs.columns
    placed = corpus_pipeline.sharding(spark, mixed, SF).collect()
    shard_of = {r.doc_id: r.shard for r in placed}
    for shard in range(8):
        rows = sorted((r.slot, r.doc_id) for r in placed if r.shard == shard)
        assert [d for _, d in rows] == [d for d in order if shard_of[d] == shard] and [s for s, _ in rows] == list(range(len(rows)))


def test_last_stages_on_odd_rows(spark, odd, none):
    """Decontamination and sharding as stages: nulls, empty and long texts, repeated rows, clashing, dotted and case-only names."""
    import corpus_pipeline

    strange = odd.withColumnRenamed("key", "a.b").withColumnRenamed("h1", "Lang")
    with_case = {"spark.sql.caseSensitive": "true"}
    held = {k: spark.conf.get(k) for k in with_case}
    for k, v in with_case.items():
        spark.conf.set(k, v)
    try:
        kept = corpus_pipeline.decontamination(spark, strange, SF)
        assert kept.columns == strange.columns and kept.count() == len(ODD)
        for docs in (strange, materialise(strange.toDF(*[c.replace(".", "_") for c in strange.columns]), "odd")):
            placed = corpus_pipeline.sharding(spark, docs, SF).collect()
            assert len(placed) == len(ODD) and all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(8))
            assert len({r.shard for r in placed if r.text_crc32 is None}) == 1
        assert corpus_pipeline.sharding(spark, none, SF).count() == 0 and corpus_pipeline.decontamination(spark, none, SF).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) and {r.shard for r in out} <= set(range(8))
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
