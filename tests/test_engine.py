import json
import os
import sqlite3
from contextlib import closing

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.__main__ import main, process_data, run_requests
from lodestone.functions import prompts, tokenizer
from lodestone.functions import text as X
from lodestone.operators import evaluation, lexical, metrics, packing, relational, retrieval
from lodestone.plans import contrastive, factory, requests, scratch
from lodestone.sources import schemas, sinks, sqlite
from lodestone.sources.registry import Config, combined_key, key_structure, resolve, write_whole

SF = "/root/testdata/sf0.001"
CHAT = "array<struct<role:string,content:string>>"


def _naive_packs(lengths, limit, always):
    packs, used = [], 0
    for i, n in enumerate(lengths):
        if i == 0 or used > limit or (not always and used + n > limit):
            packs.append([])
            used = 0
        packs[-1].append(n)
        used += n
    return packs


@pytest.mark.parametrize("always", [False, True])
@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("block_rows", [1 << 20, 64, 3])
def test_next_fit_in_long_chunks(spark, always, drop, block_rows):
    rng = np.random.default_rng(1)
    lengths = [rng.integers(0, 90, 1000 if c else 1) for c in range(5)]
    lengths[3][::50], lengths[4][400:700] = 250, 0
    rows = [(c, i, int(n), f"r{c}-{i}") for c in range(5) for i, n in enumerate(lengths[c])]
    df = spark.createDataFrame(rows, "chunk long, pos long, length long, `a.b` string").repartition(7)
    got = {}
    for r in packing.next_fit(df, 100, always, drop, block_rows).orderBy("chunk", "pos").collect():
        assert r["a.b"] == f"r{r.chunk}-{r.pos}"
        got.setdefault(r.chunk, {}).setdefault(r.pack, []).append(r.length)
    for c in range(5):
        expected = _naive_packs([n for k, _, n, _ in rows if k == c], 100, always)
        assert list(got.get(c, {}).values()) == (expected[:-1] if drop else expected)
    assert packing.next_fit(df.filter("false"), 100, always, drop).count() == 0


@pytest.mark.parametrize("block_rows", [1 << 20, 5])
def test_slice_and_pack_over_blocks(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(c, i, int(n)) for c in range(3) for i, n in enumerate(rng.integers(0, 40, 60))]
    got = packing.slice_and_pack(spark.createDataFrame(rows, "chunk long, pos long, length long").repartition(4), 16, block_rows).collect()
    for c in range(3):
        tokens = [(p, k) for x, p, n in rows if x == c for k in range(n // 16 * 16, n)]
        tails = sorted((r.pack, r.pos, r.first + k) for r in got if r.chunk == c and r.kind == "tail" for k in range(r.n))
        assert tails == sorted((i // 16, *t) for i, t in enumerate(tokens[: len(tokens) // 16 * 16]))
        full = sorted((r.pos, r.first) for r in got if r.chunk == c and r.kind == "full")
        assert full == sorted((p, k * 16) for x, p, n in rows if x == c for k in range(n // 16))


def test_retrieve_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (300, 4)).astype(float) + 0.01
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(6)
    q = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in retrieval.retrieve(q, df.withColumnRenamed("id", "document_id"), 7, skip_self=True).collect():
        got.setdefault(r.query_id, []).append(round(r.score, 9))
    for i in range(0, 300, 50):
        s = np.delete(unit @ unit[i], i)
        assert sorted(got[i], reverse=True) == np.round(np.sort(s)[::-1][:7], 9).tolist()
    assert retrieval.retrieve(q.filter("false"), df.withColumnRenamed("id", "document_id"), 3).count() == 0


@pytest.mark.parametrize("part", [1 << 14, 40])
def test_retrieve_prunes_parts_exactly(spark, monkeypatch, part):
    """Clustered vectors, one cluster with half of them, repeated vectors: the same hits as all scores, in parts of any size."""
    monkeypatch.setattr(retrieval, "PART", part)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 8))
    v = np.concatenate([centre[c] + 0.05 * rng.normal(size=(200 if c == 0 else 40, 8)) for c in range(6)])
    v[10:14] = v[9]
    v = np.round(v, 3)
    ids = rng.permutation(len(v)) * 3
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, vector array<double>").repartition(5)
    q = df.filter("id % 30 = 0").withColumnRenamed("id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k, own in ((5, True), (1, False), (500, False)):
        got = {}
        for r in retrieval.retrieve(q, df.withColumnRenamed("id", "document_id"), k, skip_self=own).collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.document_id))
        for at, i in enumerate(ids):
            if i % 30 == 0:
                scores = sorted((-round(float(unit[at] @ unit[b]), 9), int(j)) for b, j in enumerate(ids) if not own or j != i)[:k]
                assert [s for s, _ in sorted(got[int(i)])] == pytest.approx([s for s, _ in scores], abs=2e-9)
                assert len(got[int(i)]) == len({j for _, j in got[int(i)]}) == len(scores)
    if part == 40:
        placed, pivots, held = retrieval.placed_documents(df.withColumnRenamed("id", "document_id"))
        assert retrieval.visits(placed, pivots, held, q, 5).count() < q.count() * len(held) / 2
    assert retrieval.retrieve(q, df.withColumnRenamed("id", "document_id").filter("false"), 3).count() == 0


def test_guard_refuses_writes_anywhere(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS guarded_x (a INT) USING parquet")
    for sql in (
        "WITH t AS (SELECT 1 AS a) INSERT INTO guarded_x SELECT * FROM t", "INSERT INTO guarded_x VALUES (1)", "CREATE TABLE y AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 1)",
        "DROP TABLE guarded_x", "SET a = 1", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1",
    ):
        rows, error = evaluation.guarded(spark, sql)
        assert rows is None and error
    assert spark.table("guarded_x").count() == 0
    for sql in ("WITH t AS (SELECT 1 AS a) SELECT * FROM t WHERE a IN (SELECT a FROM t)", "SELECT a FROM VALUES (1) AS v(a) GROUP BY a HAVING count(*) > 0 ORDER BY a LIMIT 1", "SELECT sum(a) OVER (ORDER BY a) FROM VALUES (1) AS v(a)"):
        assert evaluation.guarded(spark, sql)[0] == [(1,)], sql
    spark.sql("DROP TABLE guarded_x")


def test_nearest_pair(spark):
    df = spark.createDataFrame([(1, ["aaa", "abc"], ["abd", "zzz", "abd"]), (2, [], ["x"]), (3, ["x"], [])], "item int, correct array<string>, wrong array<string>")
    assert [tuple(r) for r in evaluation.nearest_pair(df).collect()] == [(1, "abc", "abd")]
    assert [tuple(r) for r in evaluation.nearest_pair(df, farthest=True).collect()] == [(1, "aaa", "zzz")]


def test_numbers(spark):
    assert [X.human_number(x) for x in ("-2^0.5", "-3^2", "1.25M", "2e-3", "+5", "10Ti", "-1.5%", 7, "inf")] == [-(2**0.5), -9, 1.25e6, 0.002, 5, 10 * 2**40, -0.015, 7, float("inf")]
    with pytest.raises(ValueError):
        X.human_number("1 apple")
    df = spark.createDataFrame([(0.0,), (999.5,), (1e6,), (-2048.0,), (None,), (1e30,)], "n double")
    rows = df.select(X.human_count(F.col("n")), X.human_count(F.col("n"), binary=True)).collect()
    assert [tuple(r) for r in rows] == [("0", "0"), ("999.50", "999.50"), ("1.00M", "976.56Ki"), ("-2.05K", "-2.00Ki"), (None, None), ("1_000_000_000_000.00Qi", "827_180.61Yi")]
    spent = spark.createDataFrame([(1.5,), (60.0,), (90_061.25,), (None,)], "s double").select(X.human_seconds(F.col("s"))).collect()
    assert [r[0] for r in spent] == ["1.500s", "0:01:00", "1 day, 1:01:01", None]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(X.unit(F.col("v")).alias("u")).first().u
    assert all(np.isnan(zero))


def test_normalise_keeps_the_sign_of_zero(spark, tmp_path):
    vectors = [[1.0, -1e-7, 1e-7, -0.0], [0.6, 0.8, 0.0, -3e-7], [0.0, -0.0, 0.0, 0.0], [0.1234565, -0.9923499, 0.0000005, -0.0000005]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*vectors, None])], "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.v for r in catalog.QUERIES["x19_normalise"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.execute(catalog.ORACLE_SQL["x19_normalise"]).fetchall())
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()} and repr(got[0]) == "[1.0, -0.0, 0.0, -0.0]"
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (-1.7e308,), (-2.5,), (None,)], "x double").select(X.rounded(F.col("x"), 0), X.rounded(F.col("x"), 6))
    assert repr([tuple(r) for r in odd.collect()]) == repr([(x, x) if x != -2.5 else (-3.0, -2.5) for x in (float("inf"), float("-inf"), float("nan"), -1.7e308, -2.5, None)])


def test_tokenizers(spark):
    built = tokenizer.HashTokenizer()
    texts = ["It's naïve, 第1 _x", "", None, "a\tb\n\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    native = [r[0] for r in df.select(tokenizer.encoded(F.col("t"))).collect()]
    assert native == [None if t is None else built.encode(t)[0] for t in texts]
    import tokenizers

    words = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    words.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    own = tokenizer.FileTokenizer(words.to_str())
    assert [r[0] for r in df.select(tokenizer.encoded(F.col("t"), own, limit=2)).collect()] == [[0, 0], [], None, [1, 2]]


def test_sft_masks_packs_and_pads(spark):
    chats = [[("user", "hi there"), ("assistant", "hello you")], [("user", "x"), ("assistant", "<think>\n</think>\nyes")], [("user", "only asked")]]
    df = spark.createDataFrame(list(enumerate(chats)), f"pos long, messages {CHAT}")
    t = tokenizer.HashTokenizer()
    rows = {r.pos: r for r in factory.sft(df, 200).collect()}
    for i, chat in enumerate(chats):
        text = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in chat)
        ids, starts, ends = t.encode(text)
        spans = [(text.find(c), text.find(c) + len(c)) for r, c in chat if r == "assistant"]
        inside = [any(a >= s and z <= e for s, e in spans) for a, z in zip(starts, ends, strict=True)]
        shown = [x or y for x, y in zip(inside, [False, *inside], strict=False)]
        assert rows[i].input_ids == ids and rows[i].labels == [k if f else -100 for k, f in zip(ids, shown, strict=True)]
    unmasked = factory.sft(df, 200, mask_inputs=False).first()
    assert unmasked.labels == unmasked.input_ids
    plain, looked_past = (factory.tokenised_chats(df, ignore_empty_think=x).filter("pos = 1").first().labels for x in (False, True))
    assert sum(x != -100 for x in plain) > sum(x != -100 for x in looked_past) > 0
    total = sum(len(r.input_ids) for r in rows.values())
    packed = factory.sft(df, 200, pack=True, pad_to=0).collect()
    assert len(packed) == 1 and len(packed[0].input_ids) == 200 and sum(packed[0].lengths) == total
    assert packed[0].position_ids[:total] == [i for n in packed[0].lengths for i in range(n)] and packed[0].labels[total:] == [-100] * (200 - total)
    assert factory.sft(df, 200, pack=True, fused_share=1.0).first().position_ids == list(range(total))
    again = factory.sft(df, 200, pack=True, repeat=True).collect()
    assert sum(sum(r.lengths) for r in again) >= total * (200 // total)
    with pytest.raises(ValueError, match="short enough"):
        factory.sft(df, 3)
    with pytest.raises(ValueError, match="ranks"):
        factory.guard_rows(df, 4, "x")


def test_process_data_to_tokens(spark, tmp_path):
    chats = spark.createDataFrame([(f"question {i}", f"answer {i}") for i in range(40)], "q string, a string")
    chats.write.parquet(str(tmp_path / "chats"))
    config = {"type": "sft", "sources": [{"name": str(tmp_path / "chats"), "options": {"role_fields": {"user": "q", "assistant": "a"}}}], "train_eval_split": (0.75, 0.25), "workers": 2, "options": {"max_length": 64, "pack": True, "pad_to": 8}}
    paths = process_data(spark, config, str(tmp_path / "out"))
    parts = {p.rsplit("/", 1)[1]: spark.read.parquet(p).collect() for p in paths}
    assert {n: sum(len(r.lengths) for r in rows) for n, rows in parts.items()} == {"train": 30, "eval": 10}
    assert all(len(r.input_ids) % 8 == 0 for rows in parts.values() for r in rows)
    (tmp_path / "c.json").write_text(json.dumps({"type": "causal", "sources": [{"name": str(tmp_path / "chats"), "options": {"column": "q"}}], "min_rows": 100, "options": {"max_length": 16}}))
    main(["process-data", str(tmp_path / "c.json"), str(tmp_path / "causal")])
    packs = spark.read.parquet(str(tmp_path / "causal/train")).collect()
    assert packs and all(len(r.input_ids) == 16 for r in packs)
    with pytest.raises(ValueError, match="role"):
        resolve({"type": "instruct", "name": str(tmp_path / "chats")}).load(spark)
    spark.createDataFrame([(None, 1)], "q string, n int").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="q: string"):
        resolve({"type": "instruct", "name": str(tmp_path / "none"), "options": {"role_fields": {"user": "q"}}}).load(spark)


def test_sources(spark, tmp_path):
    c = Config("files", "HuggingFaceH4/ultrachat_200k:train[:5]")
    assert c.base_split() == "train_sft" and Config("files", "x", split="eval").base_split() == "eval"
    assert Config("files", "x", split_mapping={"train": "a"}).base_split() == "a"
    for i, name in enumerate(("train", "test")):
        folder = tmp_path / "saved" / name
        folder.mkdir(parents=True)
        for k in range(2):
            table = pa.table({"id": [10 * i + k], "m": [[{"role": "user", "content": "x"}]]})
            with pa.ipc.new_stream(folder / f"data-{k}.arrow", table.schema) as out:
                out.write_table(table)
    saved = resolve({"type": "saved", "name": f"file://{tmp_path}/saved", "split": "test"}).load(spark)
    assert sorted(r.id for r in saved.collect()) == [10, 11] and saved.first().m[0].role == "user"
    spark.range(3).write.parquet(str(tmp_path / "parts/train"))
    assert resolve({"type": "files", "name": str(tmp_path / "parts")}).load(spark).count() == 3
    cache = str(tmp_path / "cache")
    source = resolve({"type": "files", "name": str(tmp_path / "parts")})
    with pytest.raises(FileNotFoundError):
        source.load(spark, cache, fail_on_missing_cache=True)
    assert source.load(spark, cache).count() == source.load(spark, cache, fail_on_missing_cache=True).count() == 3
    assert write_whole(spark.range(9), f"{cache}/{source.config.key()}").count() == 3
    assert not [p for p in (tmp_path / "cache").iterdir() if "incomplete" in p.name]
    a, b = {"type": "files", "name": "a"}, {"type": "files", "name": "b"}
    assert combined_key([a, b]) != combined_key([b, a]) == combined_key([b, a])
    same = spark.createDataFrame([(1, str(i)) for i in range(50)], "k int, v string")
    same.write.parquet(str(tmp_path / "ties"))
    draw = lambda: sorted(r.v for r in resolve({"type": "files", "name": str(tmp_path / "ties"), "sample_count": 9}).load(spark).collect())
    assert len(draw()) == 9 and draw() == draw()
    assert "content: string" in key_structure(spark.createDataFrame([], f"m {CHAT}").schema)


def test_contrastive_batches(spark, tmp_path):
    tables = {
        "queries": spark.createDataFrame([(0, 7, [1, 2, 3]), (0, 5, [4])], "batch_id long, query_id long, input_ids array<int>"),
        "documents": spark.createDataFrame([(0, 9, [1]), (0, 8, [2, 2])], "batch_id long, document_id long, input_ids array<int>"),
        "relations": spark.createDataFrame([(0, 7, 9, 1), (0, 7, 9, 1), (0, 5, 8, -1)], "batch_id long, query_id long, document_id long, relevance int"),
    }
    sinks.write_batches(tables, str(tmp_path / "b"), {})
    r = contrastive.read_batches(spark, str(tmp_path / "b"), 2, pad_id=-1).first()
    assert r.query_ids == [5, 7] and r.query_id_tokens == [[4, -1], [1, 2]] and r.query_id_mask == [[1, 0], [1, 1]]
    assert r.document_ids == [8, 9] and [tuple(x) for x in r.relevance] == [(0, 0, -1), (1, 1, 2)]
    with pytest.raises(ValueError, match="share a name"):
        contrastive.contrastive(spark, str(tmp_path / "b"), [("train", str(tmp_path / "b"))], 2)
    sinks.write_batches({**tables, "queries": tables["queries"].union(tables["queries"])}, str(tmp_path / "c"), {})
    with pytest.raises(ValueError, match="occurs 2 times"):
        contrastive.read_batches(spark, str(tmp_path / "c"), 2)


def test_schema_texts(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, `the name` TEXT)")
        c.execute("CREATE TABLE b (k TEXT, aid INTEGER REFERENCES a, PRIMARY KEY (k, aid))")
        c.execute("INSERT INTO a VALUES (1, 'it''s')")
    c.close()
    assert sqlite.references(path) == [("b", "aid", "a", "id")]
    catalog = schemas.catalog_of(spark, {"x": path})
    plain = schemas.plain_schema(catalog).first().schema_text
    assert plain == 'a :\nid [ INTEGER ] ( "1" ) primary_key\nthe name [ TEXT ] ( "it\'s" )\n\nb :\nk [ TEXT ] (  ) primary_key\naid [ INTEGER ] (  ) primary_key b.aid=a.id'
    ddl = schemas.ddl_schema(catalog, ["ORDER"]).first().schema_text
    assert "    `the name` TEXT, -- example: [\"it's\"]" in ddl and "    PRIMARY KEY (k, aid),\n    CONSTRAINT fk_b_aid FOREIGN KEY (aid) REFERENCES a (id)\n);" in ddl
    assert prompts.filled("no places") is not None
    with pytest.raises(KeyError):
        prompts.filled("{missing}")


def test_index_and_values(spark, tmp_path):
    values = spark.createDataFrame([("x",), ("12",), ("1e5",), ("",), (None,), ("y" * 41,), ("y" * 40,), ("x",)], "value string")
    assert sorted(r.value for r in lexical.index_values(values).collect()) == ["x", "y" * 40]
    empty = lexical.build_index(spark.createDataFrame([], "value_id long, terms array<string>"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, ["x"])], "q int, terms array<string>")
    assert lexical.bm25(asked, empty, 3).count() == 0


def test_requests(spark, tmp_path):
    service = requests.OfflineTransport(lambda r: {"choices": [{"messages": r["custom_id"]}]}, delay=1)
    batch = requests.RemoteBatch(spark, str(tmp_path / "job"), per_file=2)
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")))
    asked = requests.requests(spark.createDataFrame([("a",), ("b",), ("c",)], "q string"), "q", messages, "m")
    assert batch.add(asked) == 2 and {s[1] for s in batch.state()} == {"new"}
    steps = 0
    while not requests.RemoteBatch(spark, str(tmp_path / "job")).step(service):
        steps += 1
    assert 3 <= steps < 10 and {s[1] for s in batch.state()} == {"downloaded"}
    got = requests.extracted(batch.responses(), "complete").collect()
    assert sorted((r.custom_id, r.choices[0].content) for r in got) == [(f"task_{i}", f"task_{i}") for i in range(3)]
    assert run_requests(spark, "status", str(tmp_path / "job"), None, None, "chat", None) == ["0\tdownloaded", "1\tdownloaded"]
    assert run_requests(spark, "clean", str(tmp_path / "job"), None, None, "chat", None) == [] and not (tmp_path / "job").exists()
    failing = requests.answered(asked, lambda: lambda r: 1 / 0).collect()
    assert len(failing) == 3 and all(r.response is None and "zero" in r.error for r in failing)


def test_remote_batch_works_in_tasks(spark, tmp_path):
    class Service(requests.OfflineTransport):
        def upload(self, lines):
            assert os.getpid() != driver and len(lines) <= 7
            return super().upload(lines)

        def file_status(self, file_id):
            return "error" if "task_0\"" in self._read("files", file_id) else super().file_status(file_id)

        def download(self, job_id):
            assert os.getpid() != driver
            return super().download(job_id)

    driver = os.getpid()
    service = Service(lambda r: {"choices": [{"messages": r["body"]["messages"][0]["content"]}]}, folder=f"file://{tmp_path}/service")
    batch = requests.RemoteBatch(spark, f"file://{tmp_path}/job", per_file=7)
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("é\n"), F.col("id")).alias("content")))
    asked = requests.requests(spark.range(0, 300, 1, 5), "id", messages, "m")
    assert batch.add(asked) == 43
    jobs = []
    for done in (False, False, True):
        spark.sparkContext.setJobGroup(f"step {len(jobs)}", "")
        assert batch.step(service) is done
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"step {len(jobs)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) < 20  # not some for each of 43 files
    state = batch.state()
    assert [s[0] for s in state] == list(range(43)) and [s[1] for s in state].count("failed") == 1 and {s[1] for s in state} == {"failed", "downloaded"}
    got = {r.custom_id: r.choices[0].content for r in requests.extracted(batch.responses(), "complete").collect()}
    assert len(got) == 293 and all(v == f"é\n{k[5:]}" for k, v in got.items()) and "task_0" not in got
    none = requests.RemoteBatch(spark, str(tmp_path / "none"))
    assert none.add(asked.filter("false")) == 0 and none.step(service) and none.responses().count() == 0


def test_metrics_and_exchange(spark):
    r = metrics.Recorder()
    r.record("b", 1)
    with r.timed("a"):
        pass
    with pytest.raises(KeyError):
        r.record("b", 2)
    assert list(json.loads(r.report())) == ["a", "b"] and r.report() == "{}"
    assert metrics.stop_early(5) is None and "limit" in metrics.stop_early(5, limit=5) and "horizon" in metrics.stop_early(9, 9) and metrics.stop_early(0, stopped=True)
    tokens = spark.createDataFrame([(i, (7 * i) % 6) for i in range(20)], "token int, expert int")
    rows = relational.exchange(tokens, "expert", 2, "token").collect()
    for rank in range(3):
        mine = sorted((x.slot, x.expert, x.token) for x in rows if x["rank"] == rank)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    with pytest.raises(ValueError):
        relational.upper_names(spark.createDataFrame([(1, 2)], "a int, b int").toDF("x", "X"))


@pytest.mark.parametrize("name", ["s27_sqlite_scan", "q1_plain_schema", "q2_ddl_schema", "q3_training_columns", "s24_json_lines"])
@pytest.mark.parametrize("setting", ["bare", "none"])
def test_checkpoint_folder_without_a_scheme(spark, tmp_path, monkeypatch, name, setting):
    expected = sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(scratch, "_setting", lambda spark: str(tmp_path) if setting == "bare" else None)
    folder = scratch.shared_dir(spark)
    assert folder == f"file:{tmp_path}" if setting == "bare" else folder.startswith("file:/")
    assert sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) == expected
    if setting == "bare":
        assert any(tmp_path.iterdir())


def test_sqlite_file_on_another_file_system(spark, tmp_path):
    with closing(sqlite3.connect(tmp_path / "far.sqlite")) as c:
        c.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"x{i}") for i in range(20)])
        c.commit()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    assert sorted(int(r.a) for r in sqlite.scan(spark, "viewfs://far/in/far.sqlite", "t", 4).collect()) == list(range(20))
    made = schemas.catalog_of(spark, {"x": "viewfs://far/in/far.sqlite"})
    assert [r.column_name for r in made["columns"].orderBy("column_pos").collect()] == ["a", "b"]


def _brute_bm25(values, queries, k):
    n, mean = len(values), sum(len(t) for _, t in values) / len(values)
    df = {}
    for _, t in values:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, asked in queries:
        scored = []
        for v, t in values:
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in dict.fromkeys(asked) if w in t)
            if s:
                scored.append((-round(s, 9), v))
        out[q] = [(v, pytest.approx(-float(s), abs=1e-6)) for s, v in sorted(scored)[:k]]
    return {q: x for q, x in out.items() if x}


def test_block_index_skips_blocks(spark, tmp_path):
    """Searches over values of very common and rare words equal all scores, and read far fewer postings than a join with the index would."""
    rng = np.random.default_rng(6)
    draw = lambda n: [f"w{min(int(x), 300)}" for x in rng.zipf(1.5, n)]
    values = [(i, draw(int(rng.integers(1, 12)))) for i in range(1500)]
    queries = [(i, draw(int(rng.integers(1, 6)))) for i in range(60)] + [(60, ["w1"]), (61, ["absent"]), (62, []), (63, ["w1", "w1", "w2"])]
    index = lexical.build_index(spark.createDataFrame(values, "value_id long, terms array<string>").repartition(3), str(tmp_path / "i"), size=16)
    asked = spark.createDataFrame(queries, "q long, terms array<string>")
    got = {}
    for r in lexical.bm25(asked, index, 5).orderBy("q", F.round("score", 9).desc(), "value_id").collect():
        got.setdefault(r.q, []).append((r.value_id, r.score))
    assert got == _brute_bm25(values, queries, 5)
    known = lexical._asked(asked, index)
    read = lexical.needed_blocks(known, index, 5).agg(F.sum("n")).first()[0]
    whole = known.join(index.heads.drop("top"), "term").agg(F.sum("n")).first()[0]
    assert read < whole / 2
    assert index.heads.agg(F.max("n")).first()[0] == 16 and index.heads.filter("term = 'w1'").count() > 20
    grams = spark.createDataFrame([(1, ["w1 w2", "w3", "w1 w2"]), (2, ["w3", "w3 w1"])], "question long, grams array<string>")
    found = {(r.question, r.value_id): r.score for r in lexical.gram_hits(grams, index, 5).collect()}
    expected = {}
    for question, gs in ((1, ["w1 w2", "w3"]), (2, ["w3", "w3 w1"])):
        for g in gs:
            for v, s in _brute_bm25(values, [(0, g.split(" "))], 5).get(0, []):
                expected[question, v] = max(s.expected, expected.get((question, v), 0))
    assert found == pytest.approx(expected, abs=1e-6)
