"""Contrastive training data: written batches read back, checked and collated, by named set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sequences as S
from lodestone.operators.relational import unique_or_raise


def _padded(rows: Column, longest: Column, limit: int, pad_id: int, left: bool) -> Column:
    return F.transform(rows, lambda r: S.collate(r["ids"], longest, limit, pad_id, left))


def _collated(table: DataFrame, key: str, limit: int, pad_id: int, left: bool) -> DataFrame:
    """Per batch the sorted ids, their padded token lists and the masks of these."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("input_ids").alias("ids"))))
    grouped = table.groupBy("batch_id").agg(listed.alias("r"), F.max(F.size("input_ids")).alias("longest"))
    n = F.least("longest", F.lit(limit))
    mask = lambda r: S.collate(F.transform(r["ids"], lambda _: F.lit(1)), F.col("longest"), limit, 0, left)
    return grouped.select("batch_id", F.transform("r", lambda r: r["key"]).alias(f"{key}s"), _padded(F.col("r"), F.col("longest"), limit, pad_id, left).alias(f"{key}_tokens"), F.transform("r", mask).alias(f"{key}_mask"), n.alias(f"{key}_length"))


def read_batches(spark: SparkSession, path: str, limit: int, pad_id: int = 0, left: bool = False) -> DataFrame:
    """One row a batch of a written dataset (tables ``queries``, ``documents``, ``relations``).

    Queries and documents are in the order of their ids, cut at ``limit`` and padded to the batch's longest; ``relevance`` lists
    (q, d, value), places in those orders, of every labelled pair, repeated pairs summed.  Repeated ids in a batch are an error.
    """
    queries, documents, relations = (spark.read.parquet(f"{path}/{t}") for t in ("queries", "documents", "relations"))
    unique_or_raise(queries, "batch_id", "query_id")
    unique_or_raise(documents, "batch_id", "document_id")
    q, d = _collated(queries, "query_id", limit, pad_id, left), _collated(documents, "document_id", limit, pad_id, left)
    pairs = relations.groupBy("batch_id", "query_id", "document_id").agg(F.sum("relevance").alias("value"))
    listed = pairs.groupBy("batch_id").agg(F.collect_list(F.struct("query_id", "document_id", "value")).alias("pairs"))
    both = q.join(d, "batch_id").join(listed, "batch_id", "left")
    place = lambda p: F.struct((F.array_position("query_ids", p["query_id"]) - 1).alias("q"), (F.array_position("document_ids", p["document_id"]) - 1).alias("d"), p["value"].alias("value"))
    known = F.filter(F.transform(F.coalesce("pairs", F.array()), place), lambda p: (p["q"] >= 0) & (p["d"] >= 0))
    return both.withColumn("relevance", F.array_sort(known)).drop("pairs")


def contrastive(spark: SparkSession, train: str, evaluation: list[tuple[str, str]], limit: int, **options) -> dict[str, DataFrame]:
    """``train`` and the named evaluation sets, each read by :func:`read_batches`; two sets of one name are an error."""
    names = ["train", *[n for n, _ in evaluation]]
    if len(set(names)) < len(names):
        raise ValueError(f"evaluation sets share a name: {sorted(names)}")
    return {n: read_batches(spark, p, limit, **options) for n, p in [("train", train), *evaluation]}
