"""Queries of joins, checks, aggregates, positions and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions.prompts import filled
from lodestone.operators import batches as B
from lodestone.operators import evaluation, packing, position
from lodestone.operators import relational as R
from lodestone.queries.data import _POS, _WORDS, _lengths
from lodestone.queries.retrieval import _MINED, _mined


@query("SELECT doc_id, quality, md5(text) AS digest FROM labels JOIN documents USING (doc_id)")
def j1_id_to_text(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return R.lookup(load(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id").select("doc_id", "quality", F.md5("text").alias("digest"))


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS batch_query_id FROM orders")
def j2_dense_ids(spark, d):
    return position.dense_ids(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "batch_query_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def j4_membership_mark(spark, d):
    return R.mark(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), ["doc_id"], "labelled")


@query("SELECT c_custkey, k AS o_custkey FROM (SELECT c_custkey, unnest([c_custkey, c_custkey + 1]) AS k FROM customer) WHERE k IN (SELECT o_custkey FROM orders)")
def j7_known_items(spark, d):
    listed = load(spark, d, "customer").select("c_custkey", F.array("c_custkey", F.col("c_custkey") + 1).alias("ks"))
    return R.known_items(listed, "ks", load(spark, d, "orders"), "o_custkey")


@query("SELECT count(*)::BIGINT AS rows, count(*) FILTER (k NOT IN (SELECT o_custkey FROM orders))::BIGINT AS skipped, count(*) FILTER (k % 2 = 0)::BIGINT AS even FROM (SELECT unnest([c_custkey, c_custkey + 1]) AS k FROM customer)")
def g19_counters(spark, d):
    listed = load(spark, d, "customer").select(F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("o_custkey"))
    marked = R.mark(listed, load(spark, d, "orders"), ["o_custkey"], "known")
    return R.tally(marked, skipped=~F.col("known"), even=F.col("o_custkey") % 2 == 0)


@query("SELECT conv_id, turn, d.source FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def j11_generations_to_rows(spark, d):
    from lodestone.functions.text import custom_id_number

    made = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("request_"), F.col("conv_id").cast("string")).alias("custom_id"))
    rows = made.withColumn("doc_id", custom_id_number(F.col("custom_id")))
    return rows.join(load(spark, d, "documents").select("doc_id", "source"), "doc_id").select("conv_id", "turn", "source")


@query("SELECT n_nationkey, 'Database schema:' || chr(10) || r_name || chr(10) || chr(10) || 'Question:' || chr(10) || n_name || chr(10) || chr(10) || 'Answer with one SQL query in a ```sql block.' AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey")
def j12_question_and_schema(spark, d):
    questions = load(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("db_id"), F.col("n_name").alias("question"))
    schemas = load(spark, d, "region").select(F.col("r_regionkey").alias("db_id"), F.col("r_name").alias("schema"))
    both = R.lookup(questions, schemas, "db_id")
    return both.select("n_nationkey", filled("sql_direct", schema=F.col("schema"), question=F.col("question")).alias("prompt"))


@query("""SELECT a.pos, s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) a
JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) b USING (pos)""")
def j13_positional_zip(spark, d):
    return position.zip_rows(load(spark, d, "supplier").select("s_suppkey"), load(spark, d, "customer").select("c_custkey"), "s_suppkey", "c_custkey")


@query("SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey')) t(from_table, from_column, to_table, to_column)")
def j14_foreign_keys(spark, d):
    names = [(t, c) for t in ("region", "nation", "customer") for c in load(spark, d, t).columns]
    at = {c: i for i, (_, c) in enumerate(names)}
    columns = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(names)], "i int, table_name string, column_name string")
    keys = spark.createDataFrame([(at["n_regionkey"], at["r_regionkey"]), (at["c_nationkey"], at["n_nationkey"])], "src int, dst int")
    return R.foreign_keys(columns, keys)


@query("""WITH c AS (SELECT l_suppkey AS item, l_linenumber AS candidate, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL),
z AS (SELECT item, candidate, sum(n) AS size FROM c GROUP BY ALL),
p AS (SELECT a.item, a.candidate, b.candidate AS other, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.item = b.item AND a.v = b.v AND a.candidate <> b.candidate GROUP BY ALL),
s AS (SELECT p.item, p.candidate, sum(shared::DOUBLE / (x.size + y.size - shared)) AS s FROM p JOIN z x ON x.item = p.item AND x.candidate = p.candidate JOIN z y ON y.item = p.item AND y.candidate = p.other GROUP BY ALL),
f AS (SELECT z.item, z.candidate, round(1 + coalesce(s, 0), 9) AS score FROM z LEFT JOIN s ON z.item = s.item AND z.candidate = s.candidate)
SELECT item, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS r FROM f) WHERE r = 1""")
def g11_j15_soft_vote(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("candidate"), F.col("l_returnflag").alias("value"))
    return R.soft_vote(rows)


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def g4_first_per_key(spark, d):
    return R.first_of(load(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT digest, n FROM (SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY 1) WHERE n > 1")
def g5_repeated_keys(spark, d):
    return R.repeated_keys(load(spark, d, "documents").select(F.md5("text").alias("digest")), ["digest"])


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def g6_collect_list(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(listed, lambda x: x["n_name"]).alias("names"))


@query("SELECT event_type, avg(value) AS mean, sum(value) / sum(user_id) AS ratio FROM events GROUP BY event_type")
def g13_rank_means(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), (F.sum("value") / F.sum("user_id")).alias("ratio"))


@query("SELECT lang, source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY lang, source, text")
def g18_dedupe_rows(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    return R.first_of(rows, ["lang", "source", "digest"], "doc_id")


@query("SELECT op, count(*)::BIGINT AS n FROM (SELECT 'both' AS op, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'left', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'any', doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) GROUP BY op")
def t6_set_operations(spark, d):
    a, b = load(spark, d, "documents").select("doc_id"), load(spark, d, "labels").select("doc_id")
    parts = {"both": a.intersect(b), "left": a.subtract(b), "any": a.union(b).distinct()}
    named = [f.select(F.lit(op).alias("op"), "doc_id") for op, f in parts.items()]
    return named[0].union(named[1]).union(named[2]).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


_SAME = """(SELECT count(*) FROM (SELECT {b} FROM {t} EXCEPT SELECT {a} FROM {t})) + (SELECT count(*) FROM (SELECT {a} FROM {t} EXCEPT SELECT {b} FROM {t})) = 0"""
_SIDES = {"types": ("part", "p_type", "upper(p_type)"), "names": ("part", "p_name", "lower(p_name)"), "segments": ("customer", "c_mktsegment", "trim(c_mktsegment)")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS pair, {_SAME.format(t=t, a=a, b=b)} AS same" for n, (t, a, b) in _SIDES.items()))
def t7_same_rows(spark, d):
    found = [(n, evaluation.same_set(load(spark, d, t).selectExpr(f"{a} AS x"), load(spark, d, t).selectExpr(f"{b} AS x").unionAll(load(spark, d, t).selectExpr(f"{b} AS x")))) for n, (t, a, b) in _SIDES.items()]
    return spark.createDataFrame(found, "pair string, same boolean")


_HASH = "('0x' || substr(md5('42|' || {o} || '|' || {c}), 1, 15))::BIGINT"


@query(f"SELECT {_HASH.format(o=0, c='doc_id')} AS doc_id, md5(text) AS digest FROM documents UNION ALL SELECT {_HASH.format(o=1, c='item_id')}, md5(text) FROM benchmark")
def r4_t5_scrambled_union(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    items = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.md5("text").alias("digest"))
    return R.combine_datasets([docs, items])


@query(f"""WITH l AS (SELECT doc_id, {_POS} AS pos, {_WORDS}::BIGINT AS length FROM documents), t AS (SELECT sum(length)::BIGINT AS total FROM l),
u AS (SELECT l.*, greatest(1, 3000000 // total)::INT AS times, total, sum(length) OVER (ORDER BY pos) AS upto FROM l, t)
SELECT doc_id, copy FROM (SELECT doc_id, unnest(range(times)) AS copy FROM u) UNION ALL SELECT doc_id, times FROM u WHERE upto <= 3000000 - times * total""")
def w6_repeat_to_fill(spark, d):
    return packing.repeat_to_fill(_lengths(spark, d), 3_000_000).select("doc_id", "copy")


@query("SELECT n_nationkey, n_nationkey + 25 * c AS pos FROM nation, (SELECT unnest(range(3)) AS c) WHERE n_nationkey + 25 * c < 60")
def w7_fill_iterations(spark, d):
    nation = position.with_position(load(spark, d, "nation").select("n_nationkey"), "n_nationkey")
    return position.fill_iterations(nation, nation.count(), 60)


@query(f"WITH p AS (SELECT doc_id, {_POS} AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id FROM p WHERE pos >= n // 3 AND pos < 2 * n // 3")
def w13_proportional_shard(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    low, high = position.proportional_slice(docs.count(), 1, 3)
    return docs.filter(F.col("pos").between(low, high - 1)).select("doc_id")


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS part FROM documents")
def w14_even_parts(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    return docs.select("doc_id", position.even_part(docs.count(), 7).alias("part"))


@query("""SELECT query_id, document_id, rank FROM (SELECT c_nationkey AS query_id, c_custkey AS document_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def w16_w17_blockwise_top_k(spark, d):
    scores = load(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("document_id"), F.col("c_acctbal").alias("score"))
    return R.blockwise_top_k(scores, 5, F.floor(F.col("document_id") / 100)).drop("score")


@query("SELECT p_size, p_partkey, r FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, length(p_name) DESC, p_partkey DESC) AS r FROM part) WHERE r <= 20")
def w19_relevant_values(spark, d):
    from pyspark.sql import Window

    best = Window.partitionBy("p_size").orderBy(F.col("p_retailprice").desc(), F.length("p_name").desc(), F.col("p_partkey").desc())
    return load(spark, d, "part").withColumn("r", F.row_number().over(best)).filter("r <= 20").select("p_size", "p_partkey", "r")


_KEYED = "('0x' || substr(md5('{s}|' || vec_id), 1, 15))::BIGINT"
_DEALT = " UNION ALL ".join(
    f"SELECT vec_id AS query_id, {u} AS \"use\", p // 2 + {u} * (n // 2) AS batch_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {_KEYED.format(s=u)}, vec_id) - 1 AS p, count(*) OVER () AS n FROM embeddings WHERE vec_id % 100 = 0) WHERE p // 2 < n // 2" for u in (0, 1)
)


def _dealt(spark, d):
    queries = load(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return B.query_batches(queries, 2, 2)


@query(_DEALT)
def w22_query_batches(spark, d):
    return _dealt(spark, d)


_BATCHES = f"""{_MINED},
k AS ({_DEALT}),
n AS (SELECT query_id, document_id, ((row_number() OVER (PARTITION BY query_id ORDER BY ('0x' || substr(md5('0|' || query_id || '|' || document_id), 1, 15))::BIGINT, document_id) - 1) // 2)::INT AS "use" FROM b JOIN w USING (query_id)),
m AS (SELECT batch_id, query_id, document_id, 1 AS relevance FROM k JOIN (SELECT g.* FROM g JOIN w USING (query_id)) USING (query_id) UNION ALL SELECT batch_id, query_id, document_id, -1 FROM k JOIN n USING (query_id, "use"))"""


def _relations(spark, d):
    from lodestone.operators.retrieval import negative_uses
    from lodestone.plans.scratch import materialise

    mined = materialise(_mined(spark, d), "mined")
    return materialise(B.mined_batches(_dealt(spark, d), mined.filter("relevance > 0"), negative_uses(mined, 2, 2)), "mined-batches")


@query(f"WITH {_BATCHES} SELECT * FROM m")
def r5b_mined_batches(spark, d):
    return _relations(spark, d)


@query(f"WITH {_BATCHES} SELECT batch_id, query_id, document_id, coalesce(relevance, -1) AS relevance FROM (SELECT DISTINCT batch_id, query_id FROM m) JOIN (SELECT DISTINCT batch_id, document_id FROM m) USING (batch_id) LEFT JOIN m USING (batch_id, query_id, document_id)")
def r8_in_batch_negatives(spark, d):
    return B.in_batch_relations(_relations(spark, d))


@query(f"SELECT doc_id, batch_id, ((pos % 16) // 5)::INT AS part, ((pos % 16) % 5)::INT AS row FROM (SELECT doc_id, pos, pos // 16 AS batch_id FROM (SELECT doc_id, {_POS} AS pos FROM documents)) WHERE (pos % 16) // 5 < 3")
def w24_split_batches(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id").withColumn("batch_id", position.chunk_of(16))
    return B.split_batches(docs, 3, 16).drop("pos")


_SOURCED = f"(SELECT doc_id, source, ({_POS}) // 16 AS batch_id FROM documents)"


@query(f"SELECT doc_id, source, batch_id FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY batch_id) AS r FROM {_SOURCED}) WHERE r <= 5")
def k11_r6_dev_split(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return B.first_batches(docs.select("doc_id", "source", position.chunk_of(16).alias("batch_id")), "source", 5)


def _sixteens(spark, d):
    return position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", position.chunk_of(16).alias("batch_id"))


@query(f"WITH b AS (SELECT doc_id, ({_POS}) // 16 AS batch_id FROM documents), t AS (SELECT max(batch_id) + 1 AS n FROM b) SELECT doc_id, batch_id FROM b, t WHERE batch_id >= 1003 % n")
def w26_resume(spark, d):
    b = _sixteens(spark, d)
    return B.resume(b, 1003, b.agg(F.max("batch_id")).first()[0] + 1)


@query(f"SELECT doc_id, batch_id, unnest(range(3)) AS step FROM (SELECT doc_id, ({_POS}) // 16 AS batch_id FROM documents) WHERE batch_id = 0")
def w28_repeat_first_batch(spark, d):
    return B.repeat_first(_sixteens(spark, d), 3)
