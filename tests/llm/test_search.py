import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, ranked_search, spelling, url_filter

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def _terms(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def _ranking(docs, items, k=20):
    """Every document scored for every item by the formula."""
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in set(items):
        asked = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))), r) for t, r in Counter(_terms(text)).items() if t in df]
        scored = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(r * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, w, r in asked if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out |= {(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])}
    return out


def _found(docs, items, **options):
    return sorted(map(tuple, ranked_search.search(ranked_search.build_index(docs), items, **options).collect()), key=str)


def test_ranked_search_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_TERMS", 64)
    docs = [(1, None), (2, ""), (3, " -- \n"), (4, "Straße ÉCOLE école Ω x9 X9"), (5, "x9 x9 tie"), (5, "x9 x9 tie"), (None, "x9 x9 tie"), (7, "x9 x9 tie"), (6, "x9 x9 tie"), (8, "x9 " * 30_000), (9, "alpha beta " * 50), (None, None)]
    items = [(1, "x9 tie x9"), (1, "x9 tie x9"), (1, "école"), (2, None), (3, ""), (4, "absent words"), (None, "beta BETA ΩΩ Ω straße")]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, segment int, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score int")
    for k in (20, 2):
        assert _found(rows, asked, k=k) == sorted(_ranking(docs, items, k), key=str)
    assert _found(rows.filter("false"), asked) == [] and _found(rows, asked.filter("false")) == []


def test_ranked_search_equals_all_scores(spark, monkeypatch):
    """Common and rare terms over several segments and blocks; items meet over several blocks of items."""
    monkeypatch.setattr(ranked_search, "SEGMENT_TERMS", 9000)
    monkeypatch.setattr(ranked_search, "ITEMS", 7)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i * 7 % 5003, " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 30, 80])))) for i in range(1500)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 12])))) for i in range(40)] + [(40 + i, docs[i * 31][1]) for i in range(10)]
    found = _found(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert found == sorted(_ranking(docs, items), key=str) and len(found) > 500


@pytest.mark.parametrize("seed", range(3))
def test_blocks_round_trip_and_are_skipped(seed):
    """Packed blocks give back every posting and their exact maximum; a search unpacks few of them."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(20, 60, 3000)
    numbers = np.concatenate([np.minimum(rng.zipf(1.4, n), 500) - 1 for n in lengths]).astype(np.int32)
    at = np.cumsum(lengths)
    for d in (40, 1700, 2900):  # three documents that a query will ask for
        numbers[at[d] - 12 : at[d]] = np.arange(500, 512)
    df, heads, tops, packed = ranked_search.pack(numbers, lengths, 512)
    docs, total = len(lengths), int(lengths.sum())
    rows = [(heads[t].as_py(), tops[t].as_py(), packed[t].as_py(), int(df[t])) for t in range(512) if df[t]]
    names = [t for t in range(512) if df[t]]
    segment = ranked_search.Segment(list(range(docs)), lengths, rows, docs, total)
    owner = np.repeat(np.arange(docs), lengths)
    for i, t in enumerate(names):
        want = Counter(owner[numbers == t].tolist())
        blocks = [segment.block(b) for b in range(segment.begin[i], segment.end[i])]
        got = np.concatenate([b[0] for b in blocks])
        assert got.tolist() == sorted(want)
        norm = 75 + (25 * lengths * docs) // total
        impacts = [(1_000_000_000 * want[d]) // (1000 * want[d] + 12 * norm[d]) for d in got]
        assert np.concatenate([b[1] for b in blocks]).tolist() == impacts
        assert [int(b[1].max()) for b in blocks] == segment.most[segment.begin[i] : segment.end[i]].tolist()
    fresh = ranked_search.Segment(list(range(docs)), lengths, rows, docs, total)
    lists = np.array([names.index(t) for t in (0, 1, 2, *range(500, 512))])
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * df[np.array(names)[lists]] + 1))).astype(np.int64)
    best = ranked_search.Best(3)
    ranked_search.rank_segment(fresh, lists, weights, best)
    assert sorted(best.doc_id.tolist()) == [40, 1700, 2900]
    assert len(fresh.unpacked) < len(fresh.most[np.concatenate([np.arange(fresh.begin[x], fresh.end[x]) for x in lists])])


def test_op11_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in queries.op11_ranked_search(spark, SF).collect()} == _ranking(docs, items)


def _judged(rows, rules):
    out = []
    for page, url in rows:
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", after)[0]
        path = re.match(r"[^?#]*", after[len(host) :])[0]
        host = host.translate(A_TO_Z)
        fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[2] if fit else None
        block = any(a == "block" for h, p, a in rules if h + p == rule)
        out.append((page, host, path, rule, "block" if rule is not None and block else "allow"))
    return sorted(out, key=str)


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Ex.Net?x"), (6, "http://a.ex.net/en/1#t"), (6, "http://a.ex.net/en/1#t"), (7, "http://ex.net/"), (8, "x://" + "a." * 5000 + "net/q"), (9, "http://.net/en/"), (10, "http://notex.net/EN/"), (None, "http://ex.net:80/en/"), (11, "http://É.net/é/ü?x"), (12, "http://net/" + "p" * 50_000), (13, "http://a..ex.net//en/")]


def test_url_rules_on_odd_rows(spark):
    pages = spark.createDataFrame([(*u, "k", 1) for u in URLS], "page_id long, url string, keys string, host int").repartition(3)
    rules = [("net", "/", "block"), ("ex.net", "/en/", "allow"), ("ex.net", "", "allow"), ("a.ex.net", "/en/1", "block"), ("a.ex.net", "/en/1", "allow"), ("é.net", "/é/", "block"), ("É.net", "/é/", "block"), ("", "/", "block")]
    listed = spark.createDataFrame([*rules, ("net", "/", "block"), (None, None, "block")], "host string, path string, action string")
    assert sorted(map(tuple, url_filter.judge(pages, listed).collect()), key=str) == _judged(URLS, rules)
    assert sorted(map(tuple, url_filter.judge(pages, listed, part_keys=2).collect()), key=str) == _judged(URLS, rules)
    assert {r.verdict for r in url_filter.judge(pages, listed.filter("false")).collect()} == {"allow"}
    assert url_filter.judge(pages.filter("false"), listed).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    """Far more keys outside than inside, so that several levels take part."""
    universe = spark.range(60_000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    listed = spark.range(0, 60_000, 7).select(F.concat(F.lit("h"), F.col("id")).alias("key")).union(spark.sql("SELECT 'not in the universe' AS key"))
    cascade = url_filter.build_cascade(listed, universe.union(universe))
    assert len(cascade.levels) >= 3 and len(cascade.levels[0]) < 60_000
    wrong = universe.filter(cascade.contains(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0
    assert listed.filter(~cascade.contains(F.col("key"))).count() == 0
    assert universe.filter(cascade.passes(F.col("key"), 0)).count() > 60_000 // 7 + 1
    assert not url_filter.build_cascade(listed.filter("false"), universe).levels


def test_op12_stays_in_the_jvm(spark):
    plan = queries.op12_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


def _variants(words, ratio=5):
    forms, near = {}, defaultdict(set)
    masks = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i], w[i + 1 :], len(w)].add(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for same in masks.values():
        for w in same:
            near[w] |= same - {w}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return out


@pytest.mark.parametrize("chunk", [1 << 15, 5])
def test_variants_equal_brute_force(spark, chunk):
    """Words of few letters with runs of equal ones, so that several edits give one word; small chunks split halves into parts."""
    draw = random.Random(3)
    words = {}
    while len(words) < 400:
        words["".join(draw.choices("aabé", k=draw.randint(1, 7)))] = draw.choice([1, 2, 5, 10, 60, 300])
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    near = {r.word: r.n_near for r in spelling.near_words(df, chunk=chunk).collect()}
    expected = _variants(words)
    assert near == {e[0]: e[4] for e in expected if e[4]}
    assert {tuple(r) for r in spelling.variants(df).collect()} == expected
    assert spelling.variants(df.filter("false")).count() == 0


def test_roots_follow_long_chains(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    found = spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect()
    assert {tuple(r) for r in found} == {(f"w{i}", "w37") for i in range(37)}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        low, high, least, most = (np.array(x) for x in zip(*[(a, b, c, d) for a, b, c, d in rng.integers(0, n + 1, (200, 4)) if a <= b and c <= d] or [(0, n, 0, n)], strict=True))
        rect, value = tree.report(low, high, least, most)
        got = sorted(zip(rect.tolist(), value.tolist(), strict=True))
        assert got == sorted((i, int(v)) for i, (a, b, c, d) in enumerate(zip(low, high, least, most, strict=True)) for v in values[a:b] if c <= v < d)


def _counted(docs, damage):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_word_counts_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    text = "Éléphant naïveté\u0100abcdef ABCDEFG abcdefg \U0001f600letters×more don't"
    docs = [(1, None), (2, ""), (3, text * 6), (3, text * 6), (None, text * 5), (4, "longword " * 50_000), (5, "x" * 100_000)]
    rows = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, word int").repartition(3)
    for damage in (None, 2):
        assert {r.word: r.n for r in spelling.count_words(rows, damage=damage).collect()} == _counted(docs, damage)
    assert spelling.count_words(rows.filter("false")).count() == 0


def test_op13_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op13_spelling(spark, SF).collect()} == _variants(_counted(docs, 199))
