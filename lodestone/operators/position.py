"""Row positions, exact sampling, splitting and sharding.

Spark rows have no order, so order is an explicit 0-based ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.running import order_hash, running_sum
from lodestone.plans.scratch import materialise, written


def _ranged(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """The rows in range partitions by ``order``, written with their partition ``__part`` and their place ``__i`` in it.

    Range partitioning reads its input twice, to sample it and to deal it, so what is not yet a table is written first.
    """
    dealt = written(df, name).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # Spark's row number within the partition
    return materialise(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__i", place), name)


def with_position(df: DataFrame, *order: str, out: str = "pos") -> DataFrame:
    """Add the row's place in the order of the given columns: rows are range-partitioned and numbered per partition; only partition counts are accumulated."""
    ranged = _ranged(df, order, "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return ranged.join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__o") + F.col("__i")).cast("long")).drop("__part", "__o", "__i")


def running_total(df: DataFrame, value: str, *order: str, out: str = "upto") -> DataFrame:
    """Add the sum of ``value`` up to and with the row, in the order of the given columns; only partition sums are accumulated."""
    ranged = _ranged(df, order, "totals")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.sum(value).alias("__s")).select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__s", inside).drop("__i").withColumnRenamed("__s", "__i").join(F.broadcast(offsets), "__part").withColumn(out, F.col("__o") + F.col("__i")).drop("__part", "__o", "__i")


def running_last(df: DataFrame, value: str, *order: str, out: str) -> DataFrame:
    """Add the last non-null ``value`` up to and with the row, in the order of the given columns; one value a partition is carried over."""
    ranged = _ranged(df, order, "lasts")
    ends = ranged.filter(F.col(value).isNotNull()).groupBy("__part").agg(F.max_by(value, "__i").alias("__e"))
    parts = ranged.select("__part").distinct().join(ends, "__part", "left")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__part", F.last("__e", ignorenulls=True).over(before).alias("__c"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__s", inside).drop("__i").withColumnRenamed("__s", "__i").join(F.broadcast(carried), "__part").withColumn(out, F.coalesce("__i", "__c")).drop("__part", "__i", "__c")


def shuffled_position(df: DataFrame, key: str, seed: int = 42, out: str = "pos") -> DataFrame:
    """Add the row's place in a seeded shuffle, the order of a hash of seed and key."""
    keyed = materialise(df.withColumn("__key", order_hash(F.lit(seed), F.col(key))).withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0)), "shuffled")
    return running_sum(keyed, ["__all"], "__key", [key], "__one", out).drop("__key", "__one", "__all")


def sample_exact(df: DataFrame, key: str, ratio: float | None = None, count: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``count`` or ``int(rows * ratio)`` rows; an oversized count gives all rows, still shuffled."""
    if (ratio is None) == (count is None):
        raise ValueError("give one of ratio and count")
    k = count if count is not None else int(df.count() * ratio)
    return shuffled_position(df, key, seed).filter(F.col("pos") < k)


def split_exact(df: DataFrame, key: str, eval_share: float, seed: int = 42) -> DataFrame:
    """Add ``split``: the first ceil(share * rows) of the shuffle are eval, the rest train."""
    ranked = shuffled_position(df, key, seed)
    n = df.count()
    held = -int(-(eval_share * n) // 1)
    return ranked.withColumn("split", F.when(F.col("pos") < held, "eval").otherwise("train"))


def shard_slices(rows: int, chunk: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous shard bounds in whole chunks: the first shards get one chunk more, the tail is dropped."""
    chunks = rows // chunk
    if shards > chunks:
        raise ValueError(f"{shards} shards but only {chunks} chunks")
    each, extra = divmod(chunks, shards)
    out, at = [], 0
    for i in range(shards):
        end = at + (each + (i < extra)) * chunk
        out.append((at, end))
        at = end
    return out


def proportional_slice(rows: int, shard: int, shards: int) -> tuple[int, int]:
    """The bounds ``[i * n // k, (i + 1) * n // k)``."""
    return shard * rows // shards, (shard + 1) * rows // shards


def even_part(rows: int, parts: int) -> Column:
    """The part of a positioned row when ``rows`` are cut into ``parts`` runs, the remainder spread over the first ones."""
    each, extra = divmod(rows, parts)
    head = extra * (each + 1)
    late = extra + F.floor((F.col("pos") - head) / max(each, 1))
    return F.when(F.col("pos") < head, F.floor(F.col("pos") / (each + 1))).otherwise(late).cast("int")


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add dense 0-based ids of the distinct keys in sorted order."""
    return df.join(with_position(df.select(key).distinct(), key, out=out), key)


def gather(df: DataFrame, indices: DataFrame, missing: str = "error") -> DataFrame:
    """The positioned rows (``pos``) that ``indices`` (``place, index``) name, one for each place: in any order, and as often as they are named.

    ``pos`` gives way to ``place``.  An index without a row is an error, or with ``missing="null"`` a place with nulls, or with
    ``missing="skip"`` no row.  Rows and indices meet by a join on the position, whose index side Spark can split where one is named very often.
    """
    if missing not in ("error", "null", "skip"):
        raise ValueError(f"missing must be error, null or skip, not {missing!r}")
    named = [c for c in df.columns if c != "pos"]
    rows = df.select(F.col("pos").alias("__pos"), *[F.col(f"`{c}`") for c in named])
    met = indices.select(F.col("place").alias("__place"), F.col("index").cast("long").alias("__index")).join(rows, F.col("__index") == F.col("__pos"), "inner" if missing == "skip" else "left")
    place = F.col("__place")
    if missing == "error":
        there = F.col("__pos").isNotNull()
        place = F.when(there, place).otherwise(F.raise_error(F.concat(F.lit("no row at index "), F.coalesce(F.col("__index").cast("string"), F.lit("null")))).cast(indices.schema["place"].dataType))
    return met.select(place.alias("place"), *[F.col(f"`{c}`") for c in named])


def zip_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables side by side, each in the order of its key; the longer table's rest is left out."""
    return with_position(left, left_key).join(with_position(right, right_key), "pos")


def assign_ranks(df: DataFrame, world: int, micro: int, rows: int) -> DataFrame:
    """Rank and batch of each row of a positioned table, padded by wrap-around to a multiple of ``world``; short batches are dropped."""
    per_rank = -(-rows // world)
    padded = per_rank * world
    copies = F.when(F.col("pos") < padded - rows, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    wide = df.withColumn("__c", F.explode(copies)).withColumn("place", F.col("pos") + F.col("__c") * rows).drop("__c")
    local = F.floor(F.col("place") / world)
    ranked = wide.withColumn("rank", (F.col("place") % world).cast("int")).withColumn("batch", F.floor(local / micro))
    return ranked.filter(F.col("batch") < per_rank // micro)


def repeat_rows(df: DataFrame, times: int, rows: int) -> DataFrame:
    """The positioned table ``times`` times over, positions running on."""
    return df.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("pos", F.col("pos") + F.col("__c") * rows).drop("__c")


def chunk_of(size: int) -> Column:
    """The chunk of a row by position."""
    return F.floor(F.col("pos") / size)


def fill_iterations(df: DataFrame, rows: int, wanted: int) -> DataFrame:
    """The positioned table repeated whole and cut to ``wanted`` rows; a table that is long enough stays as it is."""
    return df if rows >= wanted else repeat_rows(df, -(-wanted // rows), rows).filter(F.col("pos") < wanted)
