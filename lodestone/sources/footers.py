"""An audit of Parquet files by their footers: rows as written against rows as read, without reading any data page twice."""

from __future__ import annotations

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.plans.scratch import qualified

SCHEMA = "path string, footer_rows long, row_groups long, bytes long, problem string"
HIDDEN = ("_", ".")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Footer(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FooterReader(DataSourceReader):
    """One partition a file; a footer that cannot be read is a row with its problem."""

    def __init__(self, options):
        self.paths = options["path"].split("\n")

    def partitions(self):
        found = []
        for path in self.paths:
            system, at = opened(path)
            info = system.get_file_info(at)
            if info.type == pafs.FileType.Directory:
                # as Spark lists a folder: sorted, without hidden files
                files = [f.path for f in system.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file]
                inside = [f for f in files if not any(p.startswith(HIDDEN) for p in f[len(at) :].split("/") if p)]
                scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
                found += [scheme + f for f in sorted(inside)]
            else:
                found.append(path)
        return [_Footer(p) for p in found]

    def read(self, partition):
        system, at = opened(partition.path)
        info = system.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            yield partition.path, None, None, None, "missing"
            return
        try:
            meta = pq.read_metadata(at, filesystem=system)
        except Exception as e:  # a damaged footer is a finding
            yield partition.path, None, None, info.size, f"no footer: {str(e).splitlines()[0]}"
            return
        columns = [meta.row_group(g).column(i) for g in range(meta.num_row_groups) for i in range(meta.num_columns)]
        ends = [(c.dictionary_page_offset if c.has_dictionary_page else c.data_page_offset) + c.total_compressed_size for c in columns]
        problem = "shorter than its row groups" if ends and max(ends) > info.size else None
        yield partition.path, meta.num_rows, meta.num_row_groups, info.size, problem


class Footers(DataSource):
    """``spark.read.format("parquet_footers").load(path)``; option ``path`` may name several files and folders, a line each."""

    @classmethod
    def name(cls):
        return "parquet_footers"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FooterReader(self.options)


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, footer_rows, row_groups, bytes, problem`` of each file of the paths (files or folders), one task a file."""
    spark.dataSource.register(Footers)
    return spark.read.format("parquet_footers").option("path", "\n".join(qualified(spark, p) for p in paths)).load()


def audit(spark: SparkSession, *paths: str) -> DataFrame:
    """The footers with ``read_rows``, what a scan of each sound file gives; a difference is a problem too."""
    found = footers(spark, *paths)
    sound = [r.path for r in found.filter("problem IS NULL").select("path").toLocalIterator()]
    if not sound:
        return found.withColumn("read_rows", F.lit(None).cast("long"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = spark.read.parquet(*sound).groupBy(bare(F.col("_metadata.file_path")).alias("at")).agg(F.count(F.lit(1)).alias("read_rows"))
    joined = found.withColumn("at", bare(F.col("path"))).join(seen, "at", "left").drop("at")
    read = F.when(F.col("problem").isNull(), F.coalesce("read_rows", F.lit(0).cast("long")))
    differs = F.when(read != F.col("footer_rows"), F.concat(F.lit("read "), read.cast("string"), F.lit(" rows")))
    return joined.withColumn("read_rows", read).withColumn("problem", F.coalesce("problem", differs))
