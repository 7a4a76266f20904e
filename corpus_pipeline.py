"""The corpus pipeline: five stages, each an operator of ``lodestone.llm`` over all that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontam import decontaminate
from lodestone.llm.mixing import mix_documents
from lodestone.llm.near_dedup import keep_one
from lodestone.llm.rules import quality_filter
from lodestone.llm.sharding import shard_documents, written_order
from lodestone.plans.scratch import materialise

#: Near-duplicate signatures and latent retrieval have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the current policy rejects.

    Null and empty texts have too few words and go; a measurement that equals a bound passes; repeated rows fare alike.
    """
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies: the one with the least doc_id.

    Every null text stays, as does one of each set of equal empty ones; rows that agree in doc_id and text are one document.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows fare alike; an empty benchmark drops nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources to their target weights by the schedule, in slot order; a document appears once per pass of the mix over it.

    Documents without words are in no slot and go; a null source is a source of its own; repeated rows take the
    places of as many documents.
    """
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every document of the mix to a shard and a slot; slots follow the order in which the mix was written, so each shard keeps its interleaving.

    Equal texts share a shard, as do all null ones; slots are gapless, and repeated rows have slots of their own.  Documents that come from no
    files take their slots by a hash.
    """
    ordered, by = written_order(docs)
    placed = shard_documents(ordered, order=by)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
