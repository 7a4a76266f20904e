"""Contrastive batches: query batches and their reuse, splits, development sets, in-batch negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.position import shuffled_position


def query_batches(queries: DataFrame, per_batch: int, uses: int, seed: int = 0) -> DataFrame:
    """``query_id, use, batch_id``: each use shuffles all queries anew and deals whole batches; the remainder is dropped."""
    whole = queries.count() // per_batch
    out = None
    for use in range(uses):
        dealt = shuffled_position(queries.select("query_id"), "query_id", seed + use).withColumn("b", F.floor(F.col("pos") / per_batch)).filter(F.col("b") < whole)
        one = dealt.select("query_id", F.lit(use).alias("use"), (F.col("b") + use * whole).alias("batch_id"))
        out = one if out is None else out.unionByName(one)
    return out


def mined_batches(batches: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``batch_id, query_id, document_id, relevance``: each query's positives and its negatives of that use."""
    good = batches.join(positives.select("query_id", "document_id"), "query_id").withColumn("relevance", F.lit(1))
    bad = batches.join(negatives.select("query_id", "document_id", "use"), ["query_id", "use"]).withColumn("relevance", F.lit(-1))
    names = ["batch_id", "query_id", "document_id", "relevance"]
    return good.select(*names).unionByName(bad.select(*names))


def split_batches(batches: DataFrame, parts: int, size: int) -> DataFrame:
    """Batches of ``size`` positioned rows cut into equal parts, the remainder dropped: adds ``part``, and ``row`` within it."""
    each = size // parts
    inside = F.col("pos") % size
    cut = batches.withColumn("part", F.floor(inside / each).cast("int")).withColumn("row", (inside % each).cast("int"))
    return cut.filter(F.col("part") < parts)


def first_batches(batches: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The first ``n`` batches of each dataset."""
    kept = batches.select(by, "batch_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("batch_id"))).filter(F.col("r") <= n)
    return batches.join(kept.drop("r"), [by, "batch_id"], "left_semi")


def in_batch_relations(relations: DataFrame) -> DataFrame:
    """Every query of a batch against every document of it: labelled pairs keep their relevance, the others are negatives."""
    queries = relations.select("batch_id", "query_id").distinct()
    documents = relations.select("batch_id", "document_id").distinct()
    pairs = queries.join(documents, "batch_id").join(relations, ["batch_id", "query_id", "document_id"], "left")
    return pairs.withColumn("relevance", F.coalesce("relevance", F.lit(-1)))


def resume(batches: DataFrame, step: int, total: int) -> DataFrame:
    """Batches that are left after ``step`` steps over ``total`` batches an epoch."""
    return batches.filter(F.col("batch_id") >= step % total)


def repeat_first(batches: DataFrame, times: int) -> DataFrame:
    """Batch 0, again and again: adds ``step``."""
    return batches.filter("batch_id = 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
