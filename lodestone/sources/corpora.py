"""Public retrieval and text-to-SQL corpora brought to common tables.

Every retrieval function takes raw tables, as the corpora are published, and returns ``queries`` (QUERY_ID,
QUERY_TEXT), ``documents`` (DOCUMENT_ID, DOCUMENT_TEXT) and ``labels`` (QUERY_ID, DOCUMENT_ID), all unique.
Ids made from texts are 60-bit hashes.  Where several rows share an id, the least id or text is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normalised, title_and_body
from lodestone.operators.position import with_position
from lodestone.operators.retrieval import suffix_lookup
from lodestone.plans.running import order_hash
from lodestone.plans.scratch import materialise

#: Where public instruction datasets keep each role.
ROLE_FIELDS = {
    "nvidia/AceMath-Instruct-Training-Data": {"user": "messages.role.user", "assistant": "messages.role.assistant"},
    "HuggingFaceH4/ultrachat_200k": {"user": "messages.role.user", "assistant": "messages.role.assistant"},
    "Open-Orca/OpenOrca": {"system": "system_prompt", "user": "question", "assistant": "response"},
    "THUDM/LongAlign-10k": {"user": "messages.role.user", "assistant": "messages.role.assistant"},
    "Yukang/LongAlpaca-12k": {"user": "instruction", "assistant": "output"},
    "Open-Orca/SlimOrca": {"system": "conversations.from.system", "user": "conversations.from.human", "assistant": "conversations.from.gpt"},
    "meta-math/MetaMathQA": {"user": "query", "assistant": "response"},
    "ise-uiuc/Magicoder-OSS-Instruct-75K": {"user": "problem", "assistant": "solution"},
    "lmsys/lmsys-chat-1m": {"user": "conversation.role.user", "assistant": "conversation.role.assistant"},
}


def role_contents(df: DataFrame, path: str) -> Column:
    """Contents under a path: a plain field, or ``list.key.value`` for the items of a list whose key has the value."""
    parts = path.split(".")
    if len(parts) == 1:
        return F.when(F.col(path).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(path).cast("string")))
    listed, key, value = parts
    fields = df.schema[listed].dataType.elementType.fieldNames()
    content = next(f for f in ("content", "text", "message", "value") if f in fields)
    return F.transform(F.filter(listed, lambda m: (m[key] == value) & m[content].isNotNull() & (m[content] != "")), lambda m: m[content].cast("string"))


def instruct_messages(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``messages``: rounds of one message per role, cut to the role with the fewest; roles without any are left out."""
    lists = {r: role_contents(df, p) for r, p in roles.items()}
    held = df.select("*", *[x.alias(f"__{r}") for r, x in lists.items()])
    rounds = F.coalesce(F.array_min(F.filter(F.array(*[F.size(f"__{r}") for r in lists]), lambda n: n > 0)), F.lit(0))

    def one(i: Column) -> Column:
        return F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.get(f"__{r}", i).alias("content")) for r in lists]), lambda m: m["content"].isNotNull())

    steps = F.filter(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))), lambda i: i < rounds)
    return held.withColumn("messages", F.flatten(F.transform(steps, one))).drop(*[f"__{r}" for r in lists])


def prompt_rows(df: DataFrame, query: str, response: str, source: str) -> DataFrame:
    """``source, messages`` of one question and one answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).cast("string").alias("content"))
    return df.select(F.lit(source).alias("source"), F.array(turn("user", query), turn("assistant", response)).alias("messages"))


def question_answers(pairs: DataFrame) -> dict[str, DataFrame]:
    """From ``query, answer`` rows."""
    ids = pairs.select(order_hash(F.col("query")).alias("QUERY_ID"), order_hash(F.col("answer")).alias("DOCUMENT_ID"), "query", "answer")
    return {
        "queries": ids.groupBy("QUERY_ID").agg(F.min("query").alias("QUERY_TEXT")),
        "documents": ids.groupBy("DOCUMENT_ID").agg(F.min("answer").alias("DOCUMENT_TEXT")),
        "labels": ids.select("QUERY_ID", "DOCUMENT_ID").distinct(),
    }


def passages(corpus: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """From ``docid, title, text`` and ``query_id, query, positive_passages``; equal texts become the document with the least id."""
    texts = corpus.select(F.col("docid").cast("long").alias("id"), title_and_body(F.col("title"), F.col("text")).alias("DOCUMENT_TEXT"))
    keyed = materialise(texts.withColumn("h", F.sha2("DOCUMENT_TEXT", 256)), "passages")
    documents = keyed.groupBy("h").agg(F.min(F.struct("id", "DOCUMENT_TEXT")).alias("d")).select("h", F.col("d.id").alias("DOCUMENT_ID"), "d.DOCUMENT_TEXT")
    kept = keyed.select("id", "h").join(documents.select("h", "DOCUMENT_ID"), "h").select("id", "DOCUMENT_ID")
    pairs = asked.select(F.col("query_id").cast("long").alias("QUERY_ID"), F.explode("positive_passages").alias("p")).select("QUERY_ID", F.col("p.docid").cast("long").alias("id"))
    queries = asked.select(F.col("query_id").cast("long").alias("QUERY_ID"), F.col("query").alias("QUERY_TEXT"))
    return {"queries": queries, "documents": documents.drop("h"), "labels": pairs.join(kept, "id").select("QUERY_ID", "DOCUMENT_ID").distinct()}


def claims(wiki: DataFrame, asked: DataFrame) -> dict[str, DataFrame]:
    """From ``id, text`` pages and ``id, claim, verifiable, evidence`` (lists of annotations with the title third); queries without a known page go."""
    documents = wiki.filter("id <> ''").groupBy("id").agg(F.min("text").alias("DOCUMENT_TEXT")).select(order_hash(F.col("id")).alias("DOCUMENT_ID"), "DOCUMENT_TEXT")
    good = asked.filter("verifiable = 'VERIFIABLE'").select(F.col("id").cast("long").alias("QUERY_ID"), F.col("claim").alias("QUERY_TEXT"), F.flatten("evidence").alias("e"))
    named = good.select("QUERY_ID", F.explode("e").alias("a")).select("QUERY_ID", order_hash(F.get(F.col("a"), F.lit(2))).alias("DOCUMENT_ID")).distinct()
    labels = named.join(documents.select("DOCUMENT_ID"), "DOCUMENT_ID", "left_semi")
    queries = good.drop("e").join(labels.select("QUERY_ID"), "QUERY_ID", "left_semi")
    return {"queries": queries, "documents": documents, "labels": labels.select("QUERY_ID", "DOCUMENT_ID")}


def supported_questions(rows: DataFrame) -> dict[str, DataFrame]:
    """From ``question, context, supporting_facts``: context holds [title, JSON list of sentences], facts hold [title, number]; texts are normalised."""
    each = rows.select(F.explode("context").alias("c")).select(normalised(F.col("c")[0]).alias("title"), normalised(F.array_join(F.from_json(F.col("c")[1], "array<string>"), " ")).alias("body"))
    documents = each.groupBy("title").agg(F.min("body").alias("body")).select(order_hash(F.col("title")).alias("DOCUMENT_ID"), F.concat_ws("\n", "title", "body").alias("DOCUMENT_TEXT"))
    asked = rows.select(normalised("question").alias("q"), "supporting_facts").select(order_hash(F.col("q")).alias("QUERY_ID"), "q", "supporting_facts")
    queries = asked.groupBy("QUERY_ID").agg(F.min("q").alias("QUERY_TEXT"))
    labels = asked.select("QUERY_ID", F.explode("supporting_facts").alias("f")).select("QUERY_ID", normalised(F.col("f")[0]).alias("t")).select("QUERY_ID", order_hash(F.col("t")).alias("DOCUMENT_ID")).distinct()
    return {"queries": queries, "documents": documents, "labels": labels}


def duplicate_questions(pairs: DataFrame, bodies: DataFrame) -> dict[str, DataFrame]:
    """From ``a, b`` (title and body run together) and ``body``: each title asks for the other's body; pairs with an unknown body go, and ``counts`` (``pairs, missed``) tells how many."""
    placed = with_position(pairs.select("a", "b"), "a", "b")
    sides = materialise(placed.select("pos", F.posexplode(F.array("a", "b")).alias("side", "text")).withColumn("text_id", 2 * F.col("pos") + F.col("side")), "sides")
    found = sides.join(suffix_lookup(sides.select("text_id", "text"), bodies), "text_id").filter("body IS NOT NULL")
    whole = materialise(found.join(found.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("pos"), "pos", "left_semi"), "split-sides")
    tallied = sides.select(F.lit(1).alias("asked"), F.lit(0).alias("kept")).unionByName(whole.select(F.lit(0).alias("asked"), F.lit(1).alias("kept")))
    counts = tallied.agg(F.coalesce(F.sum("asked") / 2, F.lit(0)).cast("long").alias("pairs"), F.coalesce((F.sum("asked") - F.sum("kept")) / 2, F.lit(0)).cast("long").alias("missed"))
    title = F.regexp_replace(F.expr("substring(text, 1, char_length(text) - char_length(body))"), r"(?U)\s+$", "")
    return {
        "queries": whole.select(F.col("text_id").alias("QUERY_ID"), title.alias("QUERY_TEXT")),
        "documents": whole.select(F.col("text_id").alias("DOCUMENT_ID"), F.col("body").alias("DOCUMENT_TEXT")),
        "labels": whole.select(F.col("text_id").alias("QUERY_ID"), (F.col("text_id") + 1 - 2 * F.col("side")).alias("DOCUMENT_ID")),
        "counts": counts,
    }


def sql_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``db_id, question, evidence, SQL`` from JSON question files, one after the other; a field ``query`` is the SQL."""

    def one(path: str) -> DataFrame:
        raw = spark.read.option("multiLine", True).json(path)
        sql = next(c for c in ("SQL", "query") if c in raw.columns)
        evidence = F.col("evidence") if "evidence" in raw.columns else F.lit(None).cast("string")
        return raw.select("db_id", "question", evidence.alias("evidence"), F.col(f"`{sql}`").alias("SQL"))

    return reduce(DataFrame.unionByName, map(one, paths))
