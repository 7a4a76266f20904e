import threading
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding, packing, position
from lodestone.sources import footers, sinks
from lodestone.streaming.ahead import batches_ahead
from lodestone.streaming.packing import STATE_STORE, slice_and_pack_stream
from lodestone.streaming.windows import dropped_late, event_windows, follow, sessions

SF = "/root/testdata/sf0.001"


def _drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return q


def test_packing_as_a_stream(spark, tmp_path):
    """Micro-batches that cut the stream anywhere give the pieces of the whole table; the open pack waits in state."""
    rng = np.random.default_rng(2)
    rows = [(c, i, int(n)) for c in range(3) for i, n in enumerate(rng.integers(0, 40, 50))]
    df = spark.createDataFrame(rows, "chunk long, pos long, length long")
    for k, (a, z) in enumerate(((0, 7), (7, 8), (8, 31), (31, 50))):
        df.filter((F.col("pos") >= a) & (F.col("pos") < z)).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        for f in (tmp_path / "in" / f"b{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
            time.sleep(0.02)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        _drained(slice_and_pack_stream(follow(spark, f"{tmp_path}/in/*.parquet", df.schema, 1), 16), "packs")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    names = ["chunk", "pos", "kind", "pack", "first", "n"]
    expected = sorted(map(tuple, packing.slice_and_pack(df, 16).select(*names).collect()))
    assert sorted(map(tuple, spark.table("packs").select(*names).collect())) == expected and expected


def _event_files(spark, folder, batches):
    schema = "ts timestamp, user_id long, event_type string, value double"
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(str(t), u, "a", 1.0) for t, u in rows], "ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(f"{folder}/x{k}")
        for f in (folder / f"x{k}").glob("*.parquet"):
            f.rename(folder / f"{k}.parquet")
            time.sleep(0.02)
    return spark.createDataFrame([], schema).schema


def test_sessions_and_late_rows(spark, tmp_path):
    day = "2024-01-01 "
    batches = [
        [(day + "10:00:00", 1), (day + "10:10:00", 1), (day + "10:05:00", 2)],
        [(day + "10:35:00", 1), (day + "13:00:00", 2)],  # the first session of 1 goes on; the watermark rises to 12:00
        [(day + "13:10:00", 2)],
        [(day + "09:00:00", 1), (day + "13:20:00", 2)],  # the first is too late, as the watermark of the batch before says
        [(day + "18:00:00", 9)],
        [(day + "18:00:01", 9)],
    ]
    schema = _event_files(spark, tmp_path, batches)
    q = _drained(sessions(follow(spark, f"{tmp_path}/*.parquet", schema, 1), "user_id", "30 minutes", "1 hour"), "sessions")
    got = sorted((r.user_id, str(r.start)[11:], str(r.end)[11:], r.n) for r in spark.table("sessions").collect())
    assert got == [(1, "10:00:00", "10:35:00", 3), (2, "10:05:00", "10:05:00", 1), (2, "13:00:00", "13:20:00", 3)]
    assert dropped_late(q) == 1
    table = spark.read.schema(schema).parquet(f"{tmp_path}/*.parquet")
    assert sessions(table, "user_id").count() == 5
    slid = event_windows(table.filter("user_id = 2"), "1 hour", step="30 minutes").collect()
    assert sorted((str(r.start)[11:16], r.n) for r in slid) == [("09:30", 1), ("10:00", 1), ("12:30", 3), ("13:00", 3)]


def test_batches_ahead_of_a_slow_consumer(spark):
    df = spark.range(0, 100, 1, 5)
    seen = []
    for batch in batches_ahead(df, 7, ahead=2):
        time.sleep(0.01)
        seen.append([r.id for r in batch])
    assert sum(seen, []) == list(range(100)) and [len(b) for b in seen] == [7] * 14 + [2]
    early = batches_ahead(df, 7)
    next(early)
    before = threading.active_count()
    early.close()
    assert threading.active_count() < before
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        list(batches_ahead(df.select(F.expr("1 / (id - 50)")), 7))
    assert list(batches_ahead(df.filter("false"), 7)) == []


def test_footer_audit(spark, tmp_path):
    spark.range(0, 1000, 1, 4).write.parquet(f"{tmp_path}/t")
    files = sorted((tmp_path / "t").glob("*.parquet"))
    sound = footers.audit(spark, f"{tmp_path}/t").collect()
    assert [r.footer_rows for r in sound] == [r.read_rows for r in sound] == [250] * 4 and all(r.problem is None for r in sound)
    assert footers.footers(spark, f"{tmp_path}/t").rdd.getNumPartitions() == 4
    data = files[1].read_bytes()
    files[1].write_bytes(data[: len(data) // 2])
    files[2].unlink()
    found = {r.path.rsplit("/", 1)[1]: r for r in footers.audit(spark, *map(str, files)).collect()}
    assert found[files[0].name].read_rows == 250 and found[files[0].name].problem is None
    assert found[files[1].name].problem.startswith("no footer") and found[files[2].name].problem == "missing"


def test_gather(spark):
    rows = position.with_position(spark.range(0, 100, 10).withColumnRenamed("id", "v"), "v")
    asked = spark.createDataFrame([(0, 3), (1, 9), (2, 3), (3, 0), (4, 99), (5, None), (6, -1)], "place int, index int")
    got = {r.place: r.v for r in position.gather(rows, asked, "null").collect()}
    assert got == {0: 30, 1: 90, 2: 30, 3: 0, 4: None, 5: None, 6: None}
    assert sorted((r.place, r.v) for r in position.gather(rows, asked, "skip").collect()) == [(0, 30), (1, 90), (2, 30), (3, 0)]
    assert position.gather(rows, asked.filter("place < 4")).count() == 4
    with pytest.raises(Exception, match="no row at index 99"):
        position.gather(rows, asked.filter("place < 5")).collect()


def test_embed(spark):
    class Counting(embedding.HashedEmbedder):
        def encode(self, texts):
            assert len(texts) * max(map(len, texts)) <= 64 or len(texts) == 1
            return super().encode(texts)

    texts = ["a b", None, "", "x" * 200, "b a", "c " * 20, "d"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, `te.xt` string").coalesce(1)
    got = embedding.embed(df, Counting(8), "te.xt", "v", held=5, chars=64).collect()
    assert [r.id for r in got] == list(range(21)) and got[1].v is None and got[2].v == [0.0] * 8
    assert got[0].v == got[4].v and abs(sum(x * x for x in got[5].v) - 1) < 1e-9 and [len(r.v) for r in got if r.v] == [8] * 18
    batches = embedding.length_batches(np.array([5, 100, 7, 6]), 14)
    assert [b.tolist() for b in batches] == [[1], [2, 3], [0]]


def test_row_groups_of_whole_queries(spark, tmp_path):
    rows = [(q, q * 100 + i, float(i)) for q in range(200) for i in range(q % 7)]
    df = spark.createDataFrame(rows, "query_id long, document_id long, score double").repartition(5)
    sinks.write_grouped(df, f"{tmp_path}/g", "query_id", 10, "score")
    groups = {}
    for f in (tmp_path / "g").glob("*.parquet"):
        meta = pq.ParquetFile(f)
        for g in range(meta.num_row_groups):
            keys = meta.read_row_group(g, ["query_id"]).column(0).to_pylist()
            assert len(set(keys)) <= 10
            for k in set(keys):
                assert (f, g) == groups.setdefault(k, (f, g))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/g").collect())) == sorted(rows)
    assert set(groups) == {r[0] for r in rows} and len({v for v in groups.values()}) < 30
