"""Running sums and positions over a whole table, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60


def order_hash(*cols: Column) -> Column:
    """A pseudorandom order key of 60 bits: the head of an MD5, so that any SQL engine can state it.

    The parts are written as text with a bar between them, null as ``null``.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def bucket_bits(df: DataFrame) -> int:
    """Bits of the order key that name a bucket: eight buckets per shuffle partition, 1,024 at least."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(10, (8 * partitions - 1).bit_length())


def running_sum(df: DataFrame, part: list[str], key: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``part`` that come before.

    Rows are ordered by ``key`` (from :func:`order_hash`, so buckets of it are even) and then ``ties``.
    Each bucket of ``key`` is summed map-side; only the bucket sums are accumulated per part, and the
    rows themselves are ordered within their bucket.  ``part`` columns must not be null; ``df`` is read
    twice, so it should be a materialised narrow table.  Rows that agree in all of these are
    interchangeable.
    """
    bits = bucket_bits(df)
    rows = df.withColumn("__b", F.shiftright(F.col(key), HASH_BITS - bits))
    keys = [*part, "__b"]
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum(value).alias("__s"))
        .select(*keys, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    )
    inside = Window.partitionBy(*keys).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__w", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, keys)
        .withColumn(out, F.col("__o") + F.col("__w"))
        .drop("__b", "__w", "__o")
    )
