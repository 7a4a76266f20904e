import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import messages as M
from lodestone.functions import sequences as S
from lodestone.functions import text as X
from lodestone.functions.text import human_number, normalised, token_ids
from lodestone.operators import evaluation, packing, position, relational, tensors
from lodestone.plans.factory import build, causal, preference
from lodestone.sources.registry import Config, parse_split, resolve, slice_bounds
from lodestone.streaming.windows import event_windows, follow

SF = "/root/testdata/sf0.001"


def _text(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_text, x)) + "]"
    return f"{float(x):.6g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SF)
    expected = con.execute(catalog.ORACLE_SQL[name])
    names = sorted(c[0] for c in expected.description)
    at = {c[0]: i for i, c in enumerate(expected.description)}
    assert sorted(found.columns) == names
    a = sorted([_text(r[n]) for n in names] for r in found.collect())
    b = sorted([_text(r[at[n]]) for n in names] for r in expected.fetchall())
    assert a == b


def _packs(spark, lengths, limit, **options):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "chunk long, pos long, length long")
    out = {}
    for r in packing.next_fit(df, limit, **options).orderBy("pos").collect():
        out.setdefault(r.pack, []).append(r.length)
    return list(out.values())


def test_next_fit(spark):
    assert _packs(spark, [3, 4, 5, 2, 6], 8) == [[3, 4], [5, 2], [6]]
    assert _packs(spark, [3, 4, 5, 2, 6], 8, always_max_length=True) == [[3, 4, 5], [2, 6]]
    assert _packs(spark, [3, 4, 5, 2, 6], 8, drop_last=True) == [[3, 4], [5, 2]]


def test_slice_and_pack(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 1, 3), (0, 2, 5)], "chunk long, pos long, length long")
    rows = packing.slice_and_pack(df, 4).orderBy("pos", "kind", "pack").collect()
    assert [(r.pos, r.n) for r in rows if r.kind == "full"] == [(0, 4), (0, 4), (2, 4)]
    assert [(r.pos, r.n) for r in rows if r.kind == "tail"] == [(0, 2), (1, 2)]


def test_repeat_to_fill(spark):
    df = spark.createDataFrame([(0, 3), (1, 4)], "pos long, length long")
    assert sum(r.length for r in packing.repeat_to_fill(df, 18).collect()) == 17


def test_shards_and_samples(spark):
    assert position.shard_slices(107, 10, 3) == [(0, 40), (40, 70), (70, 100)]
    with pytest.raises(ValueError):
        position.shard_slices(5, 10, 3)
    df = spark.range(50).withColumnRenamed("id", "k")
    assert position.sample_exact(df, "k", count=80).count() == 50
    assert position.sample_exact(df, "k", ratio=0.5).count() == 25
    assert sorted(r.pos for r in position.shuffled_position(df, "k").collect()) == list(range(50))


def test_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    chat = [("system", "s"), ("user", "u1"), ("user", "u2"), ("assistant", "a1"), ("assistant", "a2")]
    df = spark.createDataFrame([(chat,)], f"m {kind}")
    r = df.select(F.size(M.role_zip(F.col("m"))), M.common_prefix(F.col("m"), F.col("m"), compat=True), M.common_prefix(F.col("m"), F.col("m"))).first()
    assert tuple(r) == (3, 4, 5)
    ids = spark.createDataFrame([([5, 2, 9],), ([5, 9],), ([9, 2],), ([],)], "a array<int>")
    assert [r[0] for r in ids.select(M.with_eos(F.col("a"), 2)).collect()] == [[5, 2], [5, 9, 2], [9, 2], [2]]


def test_numbers_and_text(spark):
    assert [human_number(x) for x in ("1K", "1Ki", "10^6", "1e6", "1.5%", "1_000")] == [1000, 1024, 10**6, 10**6, 0.015, 1000]
    df = spark.createDataFrame([("café &amp; x",), (None,)], "t string")
    assert [r[0] for r in df.select(normalised("t")).collect()] == ["café & x", None]


def test_strings_and_sequences(spark):
    df = spark.createDataFrame([(999, "", "abc"), (101_850, "XbcX", "abc"), (2_500_000, "é", "Éa"), (7 * 10**12, None, "a")], "n long, v string, q string")
    rows = df.select(X.human_count(F.col("n")).alias("h"), F.round(X.common_substring_ratio(F.col("v"), F.col("q")), 3).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("999.00", 0.0), ("101.85K", 0.5), ("2.50M", 1.0), ("7.00T", 0.0)]
    one = spark.createDataFrame([([1, 2, 3], [1, 9, 3, 4], [8, 9, 3])], "a array<int>, b array<int>, c array<int>")
    assert tuple(one.select(S.prompts_agree(F.col("a"), F.col("b")), S.prompts_agree(F.col("a"), F.col("c"))).first()) == (True, False)
    with pytest.raises(Exception, match="differ"):
        one.select(S.aligned(F.col("a"), F.col("a"), F.col("c"))).collect()
    with pytest.raises(Exception, match="no output tokens"):
        one.select(S.first_given(F.lit(None).cast("array<int>"))).collect()
    assert one.select(S.label_log_prob(F.col("a"), F.lit(-100))).first()[0] is None


def test_lookup_and_marks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2, "x")], "k int, v string")
    with pytest.raises(KeyError):
        relational.lookup(a, b, "k")
    assert relational.lookup(a.filter("k = 2"), b, "k").count() == 2
    assert sorted(r.seen for r in relational.mark(a, b, ["k"], "seen").collect()) == [False, True, True]
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 5, "z")], "item int, candidate int, value string")
    assert sorted(map(tuple, relational.soft_vote(rows).collect())) == [(0, 0, 2.0), (1, 5, 1.0)]


def test_tensors(spark):
    assert tensors.decoder_parameters(8, 100, 2, 4, 2, 16) == ((3 * 8 * 16 + 8 * 2 * 12) * 2 + 800, 8)
    df = spark.createDataFrame([([10, 20], ["a", "b", "a"])], "n array<int>, t array<string>")
    r = df.select(tensors.training_tera_ops(F.col("n"), 2, 8, 1000).alias("x"), tensors.training_tera_ops(F.col("n"), 2, 8, 1000, forward_only=True).alias("y"), tensors.hashed_embedding(F.col("t"), 8).alias("e")).first()
    assert abs(r.x - (6 * 1000 * 30 + 12 * 16 * 500) / 1e12) < 1e-15 and abs(r.y - (2 * 1000 * 30 + 2 * 16 * 500) / 1e12) < 1e-15
    assert len(r.e) == 8 and abs(sum(v * v for v in r.e) - 1) < 1e-9
    routed = spark.createDataFrame([(0, 5), (0, 3), (1, 3)], "expert int, token int")
    assert sorted((x.expert, x.token, x.slot) for x in tensors.expert_slots(routed).collect()) == [(0, 3, 0), (0, 5, 1), (1, 3, 0)]


def test_even_parts(spark):
    pos = spark.range(10).withColumnRenamed("id", "pos")
    assert [r[0] for r in pos.orderBy("pos").select(position.even_part(10, 4)).collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r[0] for r in pos.filter("pos < 2").orderBy("pos").select(position.even_part(2, 4)).collect()] == [0, 1]


def test_sources(spark):
    assert parse_split("train[:20]", {"train": "train_sft"}) == ("train_sft", ":20")
    assert slice_bounds("10%:20%", 50) == (5, 10)
    source = resolve({"type": "text", "name": f"{SF}/documents.parquet", "sample_count": 7})
    assert source.load(spark).columns == ["text"]
    spark.read.parquet(f"{SF}/region.parquet").createOrReplaceTempView("region")
    rows = resolve(Config("sql", options={"sql": "SELECT * FROM region", "column_mapping": {"r_name": "name"}, "limit": 2})).load(spark)
    assert rows.count() == 2 and "name" in rows.columns
    with pytest.raises(KeyError):
        resolve({"type": "none"})
    with pytest.raises(ValueError):
        resolve(Config("sql", options={})).load(spark)
    with pytest.raises(ValueError):
        Config("files", sample_ratio=0.5, sample_count=1)


def test_factory(spark):
    parts = build(spark, {"sources": [{"type": "text", "name": f"{SF}/documents.parquet"}], "train_eval_split": (0.9, 0.1)})
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert parts["eval"].count() == -(-n // 10) and parts["train"].count() + parts["eval"].count() == n
    packs = causal(position.with_position(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id"), 128)
    assert packs.count() > 0 and {len(r.input_ids) for r in packs.collect()} == {128}


def test_preference_pairs(spark):
    kind = "array<struct<role:string,content:string>>"
    rows = [([("user", "what is it")], [("assistant", "a long answer of words")], [("assistant", "no")]), ([("user", "hi")], [("assistant", "b")], [("assistant", "c")])]
    df = spark.createDataFrame(rows, f"prompt {kind}, chosen {kind}, rejected {kind}")
    texts = df.select(token_ids(M.chat_text(F.col("prompt"))), token_ids(F.concat(M.chat_text(F.col("prompt")), M.chat_text(F.col("chosen")))), token_ids(F.concat(M.chat_text(F.col("prompt")), M.chat_text(F.col("rejected")))))
    for limit, most in ((1000, 500), (22, 6)):
        found = preference(df, limit, most, bos=-1, eos=-2).collect()
        for r, (p, c, j) in zip(found, texts.collect(), strict=True):
            answers = [w[len(p) :] + [-2] for w in (c, j)]
            longest, prompt = max(map(len, answers)), [-1, *p]
            prompt = prompt[:most] if len(prompt) + longest > limit else prompt
            answers = [a[: limit - most] if len(prompt) + longest > limit else a for a in answers]
            assert [r.chosen_input_ids, r.rejected_input_ids] == [prompt + a for a in answers]
            assert [r.chosen_labels, r.rejected_labels] == [[-100] * len(prompt) + a for a in answers]


def test_guarded_sql(spark):
    assert evaluation.guarded(spark, "SELECT 1 AS x") == ([(1,)], None)
    assert evaluation.guarded(spark, "DROP TABLE x")[0] is None
    assert evaluation.guarded(spark, "SELEC")[0] is None
    assert evaluation.verify([(1,)], [[(1,), (1,)], [(2,)], None]) == ([0], [1, 2])
    assert evaluation.verify([], [[]]) == ([], [0])


def test_guard_sees_the_analysed_plan(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("held")
    spark.range(3).filter(F.udf(lambda x: True, "boolean")("id")).createOrReplaceTempView("owners_code")
    spark.udf.register("mine", lambda x: x)
    (tmp_path / "secret").write_text("x")
    refused = [
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir')", "SELECT reflect/**/('java.lang.System', 'getenv')", "SELECT JAVA_METHOD('java.lang.System', 'getenv')",
        "SELECT * FROM held WHERE id = (SELECT try_reflect('java.lang.System', 'nanoTime'))", "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))", f"SELECT * FROM text.`{tmp_path}/secret`",
        f"WITH c AS (SELECT * FROM text.`{tmp_path}/secret`) SELECT * FROM c", "SELECT mine(id) FROM held", "INSERT INTO held SELECT 1", "SET x = 1", "SELECT input_file_name() FROM held", "CREATE TABLE x (a int)", "SELECT * FROM python_worker_logs()",
    ]
    for sql in refused:
        assert evaluation.guarded(spark, sql)[1].startswith("not a query"), sql
    allowed = {"SELECT 'the reflect (x)'": [("the reflect (x)",)], "SELECT count(*) FROM held /* java_method( */": [(3,)], "SELECT sum(id) FROM range(4)": [(6,)], "SELECT a FROM VALUES (1) AS t(a)": [(1,)],
               "WITH held AS (SELECT 7 AS id) SELECT id FROM held": [(7,)], "SELECT count(*) FROM owners_code": [(3,)], "SELECT exists(array(1, 2), x -> x > (SELECT 1))": None}
    for sql, rows in allowed.items():
        found, error = evaluation.guarded(spark, sql)
        assert rows is None and error and "not a query" not in error or found == rows, sql
    statements = spark.createDataFrame([(i, f"SELECT {i}" if i % 2 else "DROP VIEW held") for i in range(50)], "statement_id int, sql string")
    done = list(evaluation.run_statements(spark, statements, threads=3))
    assert [d[0] for d in done] == list(range(50)) and all((rows == [(i,)]) == (i % 2 == 1) for i, rows, _ in done)
    assert spark.catalog.tableExists("held")


def test_execution_match_over_all_rows(spark):
    up, down = "SELECT id FROM range(3000) ORDER BY id", "SELECT id FROM range(3000) ORDER BY id DESC"
    assert evaluation.guarded(spark, up) == (None, "more than 1000 rows")
    assert len(evaluation.guarded(spark, "SELECT id FROM range(1000)")[0]) == 1000
    assert evaluation.execution_match(spark, up, down) == (True, None)
    assert evaluation.execution_match(spark, up, "SELECT id FROM range(2999) ORDER BY id") == (False, None)
    assert evaluation.execution_match(spark, up, "SELECT CAST(id AS string) FROM range(3000)") == (False, None)
    assert evaluation.execution_match(spark, up, "SELECT id, id FROM range(3000)") == (False, None)
    none = "SELECT 1 WHERE false"
    assert evaluation.execution_match(spark, none, "SELECT 'x', 2 WHERE false") == (True, None)
    assert evaluation.execution_match(spark, none, none, empty_matches=False) == (False, None)
    assert evaluation.execution_match(spark, none, "SELECT 1") == (False, None)
    assert evaluation.execution_match(spark, "SELECT map(1, 2, 3, 4), 5", "SELECT map(3, 4, 1, 2), 5") == (True, None)
    assert evaluation.execution_match(spark, "SELECT map(1, 2)", "SELECT map(1, 3)") == (False, None)
    assert evaluation.execution_match(spark, up, "DROP TABLE x")[0] is None


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = event_windows(follow(spark, str(tmp_path / "in"), events.schema, 1), late="100 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("windows").select("start", "event_type", "n").collect())) == sorted(map(str, event_windows(events).select("start", "event_type", "n").collect()))
