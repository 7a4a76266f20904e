"""Join-shaped and set-shaped steps of dataset building: lookups, marks, checks, id scrambling, foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.running import order_hash


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each row of ``left`` with its row of ``right``; an error if a key is absent."""
    if not missing(left, right, key).isEmpty():
        raise KeyError(f"some {key} are not to be found")
    return left.join(right, key)


def mark(left: DataFrame, right: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add whether the row's keys occur in ``right``."""
    seen = right.select(*keys).distinct().withColumn(out, F.lit(True))
    return left.join(seen, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def known_items(rows: DataFrame, listed: str, known: DataFrame, key: str) -> DataFrame:
    """``listed`` exploded to ``key``, with only keys that ``known`` has."""
    return rows.withColumn(key, F.explode(listed)).drop(listed).join(known.select(key), key, "left_semi")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their counts: empty if all is well."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_or_raise(df: DataFrame, *keys: str) -> DataFrame:
    """The table itself; an error that names a key if one repeats."""
    again = repeated_keys(df, list(keys)).first()
    if again is not None:
        raise ValueError(f"{dict(zip(keys, again[: len(keys)], strict=True))} occurs {again['n']} times")
    return df


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one least in ``order``."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__r")).select(*keys, "__r.*")


def tally(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows, and of rows that meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def scramble_ids(df: DataFrame, ordinal: int, seed: int = 42) -> DataFrame:
    """Columns whose names end in ``id`` hashed with the dataset's ordinal, so that ids of several datasets do not meet."""
    return df.select(*[order_hash(F.lit(seed), F.lit(ordinal), F.col(c)).alias(c) if c.lower().endswith("id") else F.col(c) for c in df.columns])


def combine_datasets(frames: list[DataFrame], seed: int = 42, unique: tuple[str, ...] = ()) -> DataFrame:
    """Datasets one after the other with scrambled ids, which are unique by ``unique`` or an error."""
    whole = reduce(DataFrame.unionByName, [scramble_ids(f, i, seed) for i, f in enumerate(frames)])
    return unique_or_raise(whole, *unique) if unique else whole


def exchange(tokens: DataFrame, expert: str, experts_per_rank: int, order: str) -> DataFrame:
    """Every token at the rank that holds its expert: adds ``rank`` and ``slot``, its place among the rank's tokens by expert and ``order``.

    One range partitioning by rank, expert and order; going back is a join on the token's own key.
    """
    from lodestone.operators.position import with_position

    placed = with_position(tokens.withColumn("rank", F.floor(F.col(expert) / experts_per_rank).cast("int")), "rank", expert, order)
    first = placed.groupBy("rank").agg(F.min("pos").alias("__first"))
    return placed.join(first, "rank").withColumn("slot", F.col("pos") - F.col("__first")).drop("pos", "__first")


def upper_names(df: DataFrame) -> DataFrame:
    """All column names in upper case; names that then agree are an error."""
    names = [c.upper() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names agree in upper case: {names}")
    return df.toDF(*names)


def blockwise_top_k(scores: DataFrame, k: int, block: Column) -> DataFrame:
    """The ``k`` best per query, from the ``k`` best of each block of documents."""
    order = [F.col("score").desc(), "document_id"]
    part = scores.withColumn("__b", block).withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "__b").orderBy(*order))).filter(F.col("__r") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).drop("__b", "__r")


def foreign_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Foreign keys by name: ``columns`` has ``i, table_name, column_name``, ``keys`` has pairs ``src, dst`` of column numbers."""
    a = columns.select(F.col("i").alias("src"), F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"))
    b = columns.select(F.col("i").alias("dst"), F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"))
    return keys.join(a, "src").join(b, "dst").drop("src", "dst")


def soft_vote(rows: DataFrame) -> DataFrame:
    """The candidate of each item whose multiset of values is nearest to the others': ``item, candidate, score``.

    ``rows`` holds ``item, candidate, value``.  The score sums multiset Jaccard similarities, with 1 for the
    candidate itself; the first candidate wins ties.  Similarities come from a join on (item, value) of counts.
    """
    counts = rows.groupBy("item", "candidate", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("item", "candidate").agg(F.sum("n").alias("size"))
    other = counts.select("item", F.col("candidate").alias("other"), "value", F.col("n").alias("m"))
    shared = counts.join(other, ["item", "value"]).filter("candidate <> other").groupBy("item", "candidate", "other").agg(F.sum(F.least("n", "m")).alias("both"))
    near = shared.join(sizes, ["item", "candidate"]).join(sizes.select("item", F.col("candidate").alias("other"), F.col("size").alias("osize")), ["item", "other"])
    sums = near.groupBy("item", "candidate").agg(F.sum(F.col("both") / (F.col("size") + F.col("osize") - F.col("both"))).alias("s"))
    scored = sizes.join(sums, ["item", "candidate"], "left").select("item", "candidate", F.round(1 + F.coalesce("s", F.lit(0.0)), 9).alias("score"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "candidate")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
