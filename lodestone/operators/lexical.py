"""BM25 over a stored inverted index of values, its postings in blocks by falling impact.

A value's impact for a term is its whole share of a score, fixed when the index is built.  The postings of a term stand in
blocks of falling impact, so a block's first posting bounds the block, and a common term is many rows instead of one key.
A search takes the first block of each term, whose partial sums give a score that the k-th best hit has at least.  Terms that
cannot reach it together, the weakest first, bring no hit of their own and are not read.  Of the other terms a block is read only if its
bound, with the greatest impacts of the query's other terms, can reach that score.  A hit has a posting in one of these blocks;
the values found there get their exact scores from the same postings kept by value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.position import with_position
from lodestone.plans.scratch import materialise

K1, B = 1.2, 0.75
LONGEST = 40
BLOCK = 128
#: Scores that differ by less are equal.
SAME = 9


@dataclass
class Index:
    """``blocks`` (term, block, top, postings: value_id and impact), ``by_value`` (value_id, term, impact), and the postings of a full block."""

    blocks: DataFrame
    by_value: DataFrame
    size: int

    @property
    def heads(self) -> DataFrame:
        return self.blocks.select("term", "block", "top", F.size("postings").alias("n"))


def index_values(values: DataFrame) -> DataFrame:
    """The distinct values worth an index: texts of 1 to 40 characters that are no number."""
    size = F.length("value")
    return values.filter(F.col("value").isNotNull() & size.between(1, LONGEST) & F.col("value").try_cast("double").isNull()).select("value").distinct()


def value_sample(values: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` distinct non-empty values of each ``by``, cut to 40 characters."""
    cut = values.filter("value IS NOT NULL AND value <> ''").select(by, F.substring("value", 1, LONGEST).alias("value")).distinct()
    return cut.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("value"))).filter(F.col("r") <= n).drop("r")


def build_index(values: DataFrame, path: str, size: int = BLOCK) -> Index:
    """Write the index of ``value_id, terms`` below ``path``; no task holds more of a term than a block."""
    n, mean = values.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("terms")), F.lit(0.0))).first()
    counted = values.select("value_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("value_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    scored = counted.join(frequency, "term").select("term", "value_id", (idf * weight).alias("impact"))
    scored = materialise(scored.withColumn("less", -F.round("impact", SAME)), "postings")
    scored.drop("less").write.parquet(f"{path}/by_value")
    placed = with_position(scored, "term", "less", "value_id")
    starts = placed.groupBy("term").agg(F.min("pos").alias("start"))
    block = F.floor((F.col("pos") - F.col("start")) / size).alias("block")
    posting = F.struct("value_id", "impact")
    blocks = placed.join(starts, "term").groupBy("term", block).agg(F.max("impact").alias("top"), F.collect_list(posting).alias("postings"))
    blocks.withColumn("size", F.lit(size)).write.parquet(f"{path}/blocks")
    return read_index(values.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """A written index."""
    blocks = spark.read.parquet(f"{path}/blocks")
    any_row = blocks.select("size").first()
    return Index(blocks.drop("size"), spark.read.parquet(f"{path}/by_value"), any_row["size"] if any_row else BLOCK)


def _best(postings: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by the sum of its postings, ties by value."""
    scored = postings.groupBy("q", "value_id").agg(F.sum("impact").alias("score"))
    order = Window.partitionBy("q").orderBy(F.round("score", SAME).desc(), "value_id")
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def _asked(queries: DataFrame, index: Index) -> DataFrame:
    """``q, term, top`` of the queries' terms that the index knows."""
    asked = queries.select("q", F.explode(F.array_distinct("terms")).alias("term"))
    return materialise(asked.join(index.blocks.filter("block = 0").select("term", "top"), "term"), "asked-terms")


def needed_blocks(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``q, term, block, n``: blocks that together hold a posting of each of the ``k`` best values of a query (``q, term, top``)."""
    first = index.blocks.filter("block = 0").select("term", "postings")
    seeds = asked.select("q", "term").join(first, "term").select("q", F.inline("postings"))
    reached = _best(seeds, k).groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score") - 10.0**-SAME).alias("least"))
    by_query = Window.partitionBy("q")
    bound = asked.withColumn("others", F.sum("top").over(by_query) - F.col("top")).withColumn("alone", F.count(F.lit(1)).over(by_query) == 1)
    weaker = bound.withColumn("upto", F.sum("top").over(by_query.orderBy("top", "term")))
    wanted = weaker.join(reached, "q").filter("least IS NULL OR upto >= least").select("q", "term", "alone", (F.col("least") - F.col("others")).alias("need"))
    # a query of one term finds its values in the order of the term's own blocks
    reach = F.when(F.col("alone"), F.col("block") < -(-k // index.size)).otherwise(F.col("need").isNull() | (F.col("top") >= F.col("need")))
    return wanted.join(index.heads, "term").filter(reach).select("q", "term", "block", "n")


def bm25(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The ``k`` best values of each query (``q``, ``terms``; each term counts once): ``q, value_id, score``."""
    asked = _asked(queries, index)
    needed = needed_blocks(asked, index, k).select("q", "term", "block")
    found = needed.join(index.blocks, ["term", "block"]).select("q", F.explode("postings.value_id").alias("value_id")).distinct()
    looked_up = found.join(asked.select("q", "term"), "q").join(index.by_value, ["value_id", "term"])
    return _best(looked_up.select("q", "value_id", "impact"), k).drop("r")


def gram_hits(questions: DataFrame, index: Index, k: int) -> DataFrame:
    """``question, value_id, score``: what a search for each gram of a question (``question``, ``grams``: texts of words) finds, each value once with its best score.

    Equal grams are searched once, whoever asks for them.
    """
    asked = materialise(questions.select("question", F.explode(F.array_distinct("grams")).alias("q")), "grams")
    hits = bm25(asked.select("q").distinct().withColumn("terms", F.split("q", " ")), index, k)
    return asked.join(hits, "q").groupBy("question", "value_id").agg(F.max("score").alias("score"))
