"""Written results: batch tables with their settings, part files of bounded length, row groups of whole queries, metric lines."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestone.plans.scratch import qualified
from lodestone.sources.footers import opened


def write_batches(tables: dict[str, DataFrame], path: str, settings: dict) -> None:
    """Each table below ``path``, in files that each hold a run of whole batches in order, and the settings beside them as JSON.

    A file's footer names its least and greatest batch, so one batch is read from the files around it.
    """
    for name, df in tables.items():
        df.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.parquet(f"{path}/{name}")
        spark = df.sparkSession
    line = json.dumps(settings, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/settings")


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings beside written batches."""
    return json.loads(spark.read.text(f"{path}/settings").first()[0])


def development_batches(spark: SparkSession, paths: dict[str, str], table: str, n: int = 5) -> DataFrame:
    """The first ``n`` batches of ``table`` of each written dataset, named in ``dataset``; the datasets' settings must agree."""
    settings = [read_settings(spark, p) for p in paths.values()]
    if any(s != settings[0] for s in settings):
        raise ValueError("the datasets were written with different settings")
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(f"{path}/{table}")
        first = [r[0] for r in df.select("batch_id").distinct().orderBy("batch_id").limit(n).collect()]
        one = df.filter(F.col("batch_id").isin(first)).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def write_parts(df: DataFrame, path: str, rows: int = 512_000) -> None:
    """Part files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


class _Named(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class GroupWriter(DataSourceArrowWriter):
    """Parquet files whose row groups hold whole runs of equal keys; a file appears when the whole write succeeds."""

    def __init__(self, options):
        self.path, self.key, self.keys = options["path"].rstrip("/"), options["key"], int(options["keys"])

    def write(self, iterator):
        system, at = opened(self.path)
        name, writer, held, begun = None, None, [], 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
                system.create_dir(f"{at}/_temporary", recursive=True)
                writer = pq.ParquetWriter(f"{at}/_temporary/{name}", batch.schema, filesystem=system)
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column(self.key).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            # the last key may go on in the next batch
            while len(starts) > self.keys:
                cut = int(starts[self.keys])
                writer.write_table(table.slice(0, cut), row_group_size=cut)
                table, starts = table.slice(cut), starts[self.keys :] - cut
            held = table.to_batches()
        if writer is not None:
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            writer.close()
        return _Named(name)

    def commit(self, messages):
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        for m in messages:
            if m and m.name:
                system.move(f"{at}/_temporary/{m.name}", f"{at}/{m.name}")

    def abort(self, messages):
        system, at = opened(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{at}/_temporary/{m.name}")


class GroupSink(DataSource):
    """``df.write.format("grouped_parquet")`` with options ``path``, ``key`` and ``keys`` (a row group)."""

    @classmethod
    def name(cls):
        return "grouped_parquet"

    def writer(self, schema, overwrite):
        return GroupWriter(self.options)


def write_grouped(df: DataFrame, path: str, key: str = "query_id", keys: int = 1024, *order: str) -> None:
    """Rows in files by ranges of ``key``, in row groups of ``keys`` whole keys, each key's rows in ``order``: a key is read from one row group of one file.

    A key's rows are in one row group, however many they are, so they should be bounded, as the hits of a query are.
    """
    spark = df.sparkSession
    spark.dataSource.register(GroupSink)
    dealt = df.repartitionByRange(key).sortWithinPartitions(key, *order)
    dealt.write.format("grouped_parquet").option("path", qualified(spark, path)).option("key", key).option("keys", keys).mode("append").save()


def append_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """One JSON line with sorted keys, appended."""
    line = json.dumps(metrics, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def write_report(spark: SparkSession, path: str, report) -> None:
    """A result as indented JSON, other than ASCII kept, in one text file."""
    text = json.dumps(report, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_requests(requests: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Positioned JSON requests (``pos``, ``value``) in files of ``per_file`` lines, one folder a file number, in order."""
    rows = requests.withColumn("file", F.floor(F.col("pos") / per_file))
    rows.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").write.partitionBy("file").text(path)
