import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import process_data
from lodestone.operators.position import running_last, running_total
from lodestone.operators.retrieval import suffix_lookup
from lodestone.plans.running import order_hash
from lodestone.sources import corpora, sinks, sqlite
from lodestone.sources.registry import Config, resolve

SF = "/root/testdata/sf0.001"


def _hash(spark, text):
    return spark.range(1).select(order_hash(F.lit(text))).first()[0]


def test_claims(spark):
    wiki = spark.createDataFrame([("A", "about a"), ("", "none"), ("B", "about b"), ("A", "again")], "id string, text string")
    note = lambda *titles: [[["1", "2", t, "0"] for t in titles]]
    asked = spark.createDataFrame([(1, "x", "VERIFIABLE", note("A", "A", "Z")), (2, "y", "NOT VERIFIABLE", note("B")), (3, "z", "VERIFIABLE", note("Z"))], "id int, claim string, verifiable string, evidence array<array<array<string>>>")
    t = corpora.claims(wiki, asked)
    assert [tuple(r) for r in t["queries"].collect()] == [(1, "x")]
    assert [tuple(r) for r in t["labels"].collect()] == [(1, _hash(spark, "A"))]
    assert sorted(r.DOCUMENT_TEXT for r in t["documents"].collect()) == ["about a", "about b"]


def test_supported_questions(spark):
    rows = spark.createDataFrame([("q &amp; r", [["T", json.dumps(["one.", "two."])], ["U", json.dumps([])]], [["T", "0"], ["T", "1"]])], "question string, context array<array<string>>, supporting_facts array<array<string>>")
    t = corpora.supported_questions(rows)
    assert sorted(r.DOCUMENT_TEXT for r in t["documents"].collect()) == ["T\none. two.", "U\n"]
    assert [tuple(r) for r in t["labels"].collect()] == [(_hash(spark, "q & r"), _hash(spark, "T"))]


def test_passages_map_copies(spark):
    corpus = spark.createDataFrame([(3, "-", "same"), (1, "", "same"), (2, "t", "other")], "docid int, title string, text string")
    asked = spark.createDataFrame([(7, "q", [(3,), (1,), (2,)])], "query_id int, query string, positive_passages array<struct<docid:int>>")
    t = corpora.passages(corpus, asked)
    assert sorted(tuple(r) for r in t["documents"].collect()) == [(1, "same"), (2, "t\nother")]
    assert sorted(tuple(r) for r in t["labels"].collect()) == [(7, 1), (7, 2)]


def test_duplicate_questions(spark):
    pairs = spark.createDataFrame([("How? It is a body", "Why?\nIt is b body"), ("What? unknown", "Why? It is a body")], "a string, b string")
    bodies = spark.createDataFrame([("It is a body",), ("It is b body",)], "body string")
    t = corpora.duplicate_questions(pairs, bodies)
    assert sorted(r.QUERY_TEXT for r in t["queries"].collect()) == ["How?", "Why?"]
    assert tuple(t["counts"].first()) == (2, 1) and tuple(corpora.duplicate_questions(pairs.filter("false"), bodies)["counts"].first()) == (0, 0)
    got = {(a.QUERY_ID, a.DOCUMENT_ID) for a in t["labels"].collect()}
    assert len(got) == 2 and got == {(b, a) for a, b in got}


def test_suffix_lookup_against_brute_force(spark):
    bodies = ["a", "ba", "cba", "xa", "b", ""]
    texts = ["zba", "dcba", "qa", "b", "", "zzz", "xxa", "zba"]
    b, t = spark.createDataFrame([(x,) for x in bodies], "body string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    expected = {}
    for i, x in enumerate(texts):
        below = [r for r in (y[::-1] for y in bodies) if r <= x[::-1]]
        near = max(below)[::-1] if below else None
        expected[i] = near if near is not None and x.endswith(near) else None
    assert {r.text_id: r.body for r in suffix_lookup(t, b).collect()} == expected


def test_running_values(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"), F.lit(2).alias("n"))
    assert [r.last for r in running_last(rows, "v", "k", out="last").orderBy("k").collect()] == [i - i % 7 for i in range(50)]
    assert [r.upto for r in running_total(rows, "n", "k").orderBy("k").collect()] == [2 * i + 2 for i in range(50)]


def test_instruct_messages(spark, tmp_path):
    kind = "conversations array<struct<`from`:string,value:string>>"
    rows = [([("system", "s"), ("human", "u1"), ("human", "u2"), ("gpt", "a1"), ("gpt", "a2")],), ([("gpt", "")],), (None,)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "chats"))
    config = {"type": "instruct", "name": str(tmp_path / "chats"), "options": {"dataset": "Open-Orca/SlimOrca"}}
    found = resolve(config).load(spark).collect()
    assert [[(m.role, m.content) for m in r.messages] for r in found] == [[("system", "s"), ("user", "u1"), ("assistant", "a1")]]
    flat = spark.createDataFrame([("q", "r")], "query string, response string")
    assert [m.content for m in corpora.instruct_messages(flat, corpora.ROLE_FIELDS["meta-math/MetaMathQA"]).first().messages] == ["q", "r"]
    assert corpora.prompt_rows(flat, "query", "response", "Aya").first().source == "Aya"


def test_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(2).withColumn("x", F.lit("x")).write.parquet(str(tmp_path / "b"))
    (tmp_path / "c").mkdir()
    with pytest.warns(UserWarning, match="left out"):
        df = resolve({"type": "folders", "name": str(tmp_path)}).load(spark)
    assert df.count() == 5 and df.filter("x IS NULL").count() == 3
    with pytest.raises(Exception):
        resolve(Config("folders", name=str(tmp_path), options={"skip_unreadable": False})).load(spark)


def test_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"db_id": "d", "question": "q", "query": "SELECT 1"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"db_id": "e", "question": "r", "evidence": "v", "SQL": "SELECT 2"}]))
    rows = corpora.sql_questions(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert sorted(map(tuple, rows), key=str) == [("d", "q", None, "SELECT 1"), ("e", "r", "v", "SELECT 2")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "my table" (id INTEGER PRIMARY KEY, name TEXT, n REAL)')
        c.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', [(i, None if i % 5 == 0 else f"name {i % 3}" * 9, i / 2) for i in range(1, 101)])
        c.execute("CREATE TABLE none (k TEXT PRIMARY KEY) WITHOUT ROWID")
        c.execute("INSERT INTO none VALUES ('a')")
        c.execute("CREATE TABLE void (k TEXT)")
    assert set(sqlite.statements(path)) == {"my table", "none", "void"}
    assert ("my table", "id", "INTEGER", True) in sqlite.columns(path)
    shown = sqlite.examples(path, limit=2)
    assert len(shown["my table.name"]) == 2 and all(len(v) == 40 for v in shown["my table.name"]) and "void.k" not in shown
    df = sqlite.scan(spark, path, "my table", parts=7)
    assert df.count() == 100 and df.select("id").distinct().count() == 100 and df.filter("name IS NULL").count() == 20
    assert sqlite.scan(spark, path, "none").collect()[0].k == "a"
    assert sqlite.scan(spark, path, "void").count() == 0
    with pytest.raises(KeyError):
        sqlite.scan(spark, path, "absent")


def test_process_data(spark, tmp_path):
    config = {"sources": [{"type": "text", "name": f"{SF}/documents.parquet"}], "train_eval_split": [0.9, 0.1]}
    paths = process_data(spark, config, str(tmp_path))
    assert sum(spark.read.parquet(p).count() for p in paths) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_sinks(spark, tmp_path):
    rows = spark.range(70).select((F.col("id") % 7).alias("batch_id"), F.col("id").alias("row"))
    for name, settings in (("a", {"size": 10}), ("b", {"size": 10}), ("c", {"size": 9})):
        sinks.write_batches({"queries": rows}, str(tmp_path / name), settings)
    assert sinks.read_settings(spark, str(tmp_path / "a")) == {"size": 10}
    dev = sinks.development_batches(spark, {n: str(tmp_path / n) for n in "ab"}, "queries")
    assert dev.count() == 100 and dev.agg(F.max("batch_id")).first()[0] == 4
    with pytest.raises(ValueError):
        sinks.development_batches(spark, {n: str(tmp_path / n) for n in "ac"}, "queries")
    sinks.append_metrics(spark, str(tmp_path / "m"), {"b": 1, "a": 2})
    sinks.append_metrics(spark, str(tmp_path / "m"), {"a": 3})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "m")).collect()) == ['{"a": 2, "b": 1}', '{"a": 3}']
    sinks.write_parts(rows.coalesce(1), str(tmp_path / "p"), 30)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    asked = spark.range(25).select(F.col("id").alias("pos"), F.format_string('{"n": %d}', "id").alias("value"))
    sinks.write_requests(asked, str(tmp_path / "r"), 10)
    assert [json.loads(f"{x}")["n"] for x in next((tmp_path / "r" / "file=2").glob("*.txt")).read_text().splitlines()] == list(range(20, 25))
