"""Queries of the retrieval pipeline and the dataflow tensor operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions.text import dot, rounded, unit
from lodestone.operators import position, retrieval, tensors
from lodestone.plans.scratch import materialise

_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_S = f"""s0 AS (SELECT q.vec_id AS query_id, d.vec_id AS document_id, q.label = d.label AS hit,
  list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS score FROM {_V} q, {_V} d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s0),
s AS (SELECT * FROM s1 WHERE rank <= 50)"""
_MINED = f"""{_S},
g AS (SELECT query_id, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS r FROM s WHERE hit) WHERE r <= 1),
c AS (SELECT query_id, min(score) * 0.95::DOUBLE AS cut FROM g GROUP BY query_id),
b AS (SELECT query_id, document_id FROM (SELECT s.query_id, s.document_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.document_id) AS r FROM s JOIN c ON s.query_id = c.query_id WHERE NOT hit AND score < cut) WHERE r <= 4),
w AS (SELECT query_id FROM b GROUP BY query_id HAVING count(*) = 4)"""


def _scored(spark, d):
    """The 50 nearest of all rows to every row whose id is divisible by 100, itself left out; written, as several steps read it."""
    e = load(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return materialise(retrieval.retrieve(q, e.select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector")), 50, skip_self=True), "scored")


def _hits(spark, d, scored):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    q = scored.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id")
    return q.join(e.select(F.col("vec_id").alias("document_id"), F.col("label").alias("b")), "document_id").filter("a = b").select("query_id", "document_id")


def _mined(spark, d):
    scored = _scored(spark, d)
    return retrieval.mine(scored, _hits(spark, d, scored), negatives=4)


@query(f"WITH {_S} SELECT query_id, document_id, round(score, 6) AS score FROM s")
def r2_top_k_retrieval(spark, d):
    return _scored(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_MINED} SELECT query_id, document_id, 1 AS relevance FROM g JOIN w USING (query_id) UNION ALL SELECT query_id, document_id, -1 FROM b JOIN w USING (query_id)")
def r3_mine_hard_negatives(spark, d):
    return _mined(spark, d)


@query(f"""WITH {_MINED},
r AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY ('0x' || substr(md5('0|' || query_id || '|' || document_id), 1, 15))::BIGINT, document_id) - 1 AS r FROM b JOIN w USING (query_id))
SELECT query_id, document_id, (r // 2)::INT AS use FROM r""")
def w21_negative_uses(spark, d):
    return retrieval.negative_uses(_mined(spark, d), 2, 2)


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS v FROM embeddings")
def x19_normalise(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.transform(unit(F.col("embedding")), lambda x: rounded(x, 6)).alias("v"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS d FROM embeddings")
def x20_dot_product(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("d"))


@query("""WITH p AS (SELECT l_orderkey AS query_id, l_partkey AS document_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, count(*) OVER () AS n FROM lineitem),
b AS (SELECT *, pos // 64 AS batch_id FROM p WHERE pos < n - n % 64)
SELECT batch_id::BIGINT AS batch_id, query_id, document_id, (dense_rank() OVER (PARTITION BY batch_id ORDER BY query_id) - 1)::INT AS batch_query_id, (dense_rank() OVER (PARTITION BY batch_id ORDER BY document_id) - 1)::INT AS batch_document_id FROM b""")
def r5a_pair_batches(spark, d):
    pairs = position.with_position(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("document_id"), "l_linenumber"), "query_id", "l_linenumber", "document_id")
    return retrieval.pair_batches(pairs, 64, pairs.count()).select("batch_id", "query_id", "document_id", "batch_query_id", "batch_document_id")


@query("SELECT l_orderkey AS q, l_suppkey AS d, sum(l_quantity) AS rel FROM lineitem GROUP BY ALL")
def g16_coo_coalesce(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("d")).agg(F.sum("l_quantity").alias("rel"))


@query("SELECT l_orderkey - 100 AS q, l_suppkey - 10 AS d, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 299 AND l_suppkey BETWEEN 10 AND 19")
def w25_sparse_slice(spark, d):
    part = load(spark, d, "lineitem").filter("l_orderkey BETWEEN 100 AND 299 AND l_suppkey BETWEEN 10 AND 19")
    return part.select((F.col("l_orderkey") - 100).alias("q"), (F.col("l_suppkey") - 10).alias("d"), "l_linenumber")


@query("""WITH b AS (SELECT DISTINCT p_type AS body FROM part), t AS (SELECT p_partkey AS text_id, p_name || ' ' || p_type AS text FROM part),
m AS (SELECT text_id, text, (SELECT max(reverse(body)) FROM b WHERE reverse(body) <= reverse(text) AND substr(reverse(body), 1, 1) = substr(reverse(text), 1, 1)) AS k FROM t)
SELECT text_id, CASE WHEN suffix(text, reverse(k)) THEN reverse(k) END AS body FROM m""")
def j8_suffix_lookup(spark, d):
    part = load(spark, d, "part")
    return retrieval.suffix_lookup(part.select(F.col("p_partkey").alias("text_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), part.select(F.col("p_type").alias("body")).distinct())


@query(f"""WITH {_S}, x AS (SELECT *, CASE WHEN hit THEN 1 ELSE -1 END AS rel FROM s),
n AS (SELECT query_id, sum(exp(score / 0.5::DOUBLE)) AS others FROM x WHERE rel < 0 GROUP BY query_id)
SELECT x.query_id, x.document_id, round(ln(exp(score / 0.5::DOUBLE) + coalesce(others, 0)) - score / 0.5::DOUBLE, 5) AS loss FROM x LEFT JOIN n USING (query_id) WHERE rel > 0""")
def n2_info_nce(spark, d):
    scored = _scored(spark, d)
    hits = _hits(spark, d, scored).withColumn("relevance", F.lit(1))
    rel = scored.join(hits, ["query_id", "document_id"], "left").fillna(-1, ["relevance"])
    return retrieval.info_nce(rel, 0.5).withColumn("loss", F.round("loss", 5))


@query("""WITH t AS (SELECT label AS seq, vec_id AS pos, embedding AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS z FROM embeddings WHERE vec_id % 3 <> 0),
m AS (SELECT seq, i, avg(x) AS mean FROM (SELECT seq, unnest(range(0, len(v))) AS i, unnest(v)::DOUBLE AS x FROM t) GROUP BY ALL)
SELECT m.seq, m.i::INT AS i, round(mean, 5) AS mean, round(a.v[m.i + 1]::DOUBLE, 5) AS first, round(b.v[m.i + 1]::DOUBLE, 5) AS last FROM m JOIN t a ON a.seq = m.seq AND a.r = 1 JOIN t b ON b.seq = m.seq AND b.z = 1""")
def n1_pooling(spark, d):
    tokens = load(spark, d, "embeddings").select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3 != 0).alias("mask"))
    pooled = tensors.pooled(tokens)
    show = lambda c: F.round(F.get(c, F.col("i")).cast("double"), 5).alias(c)
    return pooled.select("seq", F.posexplode("mean").alias("i", "m"), "first", "last").select("seq", "i", F.round("m", 5).alias("mean"), show("first"), show("last"))


_GATE = """g AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM g)"""


def _gates(spark, d):
    each = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    e = F.exp(F.col("x").cast("double"))
    p = each.select("vec_id", F.col("i").cast("long").alias("i"), (e / F.sum(e).over(Window.partitionBy("vec_id"))).alias("p"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("p").desc(), "i"))).filter("r <= 2")


@query(f"WITH {_GATE} SELECT i AS expert, count(*)::BIGINT AS n, round(sum(p), 5) AS weight FROM t WHERE r <= 2 GROUP BY i")
def n6_top_k_gating(spark, d):
    return _gates(spark, d).groupBy(F.col("i").alias("expert")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 5).alias("weight"))


@query(f"WITH {_GATE} SELECT i AS expert, vec_id AS token, (row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1)::BIGINT AS slot FROM t WHERE r <= 2")
def n7_scatter(spark, d):
    return tensors.expert_slots(_gates(spark, d).select(F.col("i").alias("expert"), F.col("vec_id").alias("token")))


@query(f"WITH {_GATE} SELECT vec_id AS token, round(sum(p * (i + 1)), 5) AS y FROM t WHERE r <= 2 GROUP BY vec_id")
def n8_gather(spark, d):
    return _gates(spark, d).groupBy(F.col("vec_id").alias("token")).agg(F.round(F.sum(F.col("p") * (F.col("i") + 1)), 5).alias("y"))


@query("""WITH s AS (SELECT vec_id, list_sum(embedding[1:16]::DOUBLE[]) AS c, list_sum(embedding[17:32]::DOUBLE[]) AS r, list_sum(embedding[33:48]::DOUBLE[]) AS rc, list_sum(embedding[49:64]::DOUBLE[]) AS rr FROM embeddings),
g AS (SELECT *, 0.1::DOUBLE * ((c - r) - (rc - rr)) AS z FROM s)
SELECT vec_id, round(0.8::DOUBLE * ln(1 + exp(-z)) + 0.2::DOUBLE * ln(1 + exp(z)), 5) AS loss, round(0.1::DOUBLE * (c - rc), 5) AS chosen_reward, round(0.1::DOUBLE * (r - rr), 5) AS rejected_reward FROM g""")
def n5_preference_loss(spark, d):
    part = lambda i: F.aggregate(F.slice("embedding", 16 * i + 1, 16), F.lit(0.0), lambda s, x: s + x.cast("double"))
    found = tensors.preference_loss(part(0), part(1), part(2), part(3), beta=0.1, smoothing=0.2)
    return load(spark, d, "embeddings").select("vec_id", *[F.round(c, 5).alias(n) for n, c in found.items()])


_HASH60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query(f"""WITH p AS (SELECT u.text AS q, a.text AS d FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT DISTINCT {_HASH60.format('q')} AS "QUERY_ID", {_HASH60.format('d')} AS "DOCUMENT_ID", q AS "QUERY_TEXT", d AS "DOCUMENT_TEXT" FROM p""")
def s28_question_answers(spark, d):
    from lodestone.sources.corpora import question_answers

    turns = load(spark, d, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    pairs = asked.join(turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])
    t = question_answers(pairs)
    return t["labels"].join(t["queries"], "QUERY_ID").join(t["documents"], "DOCUMENT_ID")


@query("""WITH d AS (SELECT doc_id, CASE WHEN trim(source) IN ('', '-') THEN text ELSE source || chr(10) || text END AS t FROM documents),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS kept FROM d)
SELECT DISTINCT quality AS "QUERY_ID", kept AS "DOCUMENT_ID" FROM labels JOIN k USING (doc_id)""")
def s28_passages(spark, d):
    from lodestone.sources.corpora import passages

    corpus = load(spark, d, "documents").select(F.col("doc_id").alias("docid"), F.col("source").alias("title"), "text")
    grouped = load(spark, d, "labels").groupBy(F.col("quality").alias("query_id")).agg(F.collect_list(F.struct(F.col("doc_id").alias("docid"))).alias("positive_passages"))
    return passages(corpus, grouped.withColumn("query", F.col("query_id").cast("string")))["labels"]


@query("""WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name || ' the body of ' || s_suppkey, s_name || ' the body of 0') - 1 AS pos FROM supplier WHERE s_suppkey > 0)
SELECT (2 * pos + u)::BIGINT AS "QUERY_ID", CASE WHEN u = 0 THEN s_name || ' the' ELSE s_name || ' the' END AS "QUERY_TEXT" FROM p JOIN supplier USING (s_suppkey), (SELECT unnest([0, 1]) AS u)""")
def s28_duplicate_questions(spark, d):
    from lodestone.sources.corpora import duplicate_questions

    s = load(spark, d, "supplier").filter("s_suppkey > 0")
    joined = lambda n: F.concat("s_name", F.lit(" the "), F.lit("body of "), n.cast("string"))
    bodies = s.select(F.concat(F.lit("body of "), F.col("s_suppkey").cast("string")).alias("body")).unionByName(spark.createDataFrame([("body of 0",)], "body string"))
    return duplicate_questions(s.select(joined(F.col("s_suppkey")).alias("a"), joined(F.lit(0)).alias("b")), bodies)["queries"]


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda y: y::DOUBLE * y::DOUBLE)) * list_sum(list_transform({b}, lambda y: y::DOUBLE * y::DOUBLE)))"
_NCE = """n{k} AS (SELECT query_id, sum(exp({s} / 0.5::DOUBLE)) AS others FROM c WHERE NOT hit GROUP BY query_id),
l{k} AS (SELECT c.query_id, c.document_id, ln(exp({s} / 0.5::DOUBLE) + coalesce(others, 0)) - {s} / 0.5::DOUBLE AS loss FROM c LEFT JOIN n{k} USING (query_id) WHERE hit)"""


@query(f"""WITH {_S}, p AS (SELECT s.query_id, s.document_id, q.label = d.label AS hit, q.embedding AS a, d.embedding AS b FROM s JOIN embeddings q ON q.vec_id = s.query_id JOIN embeddings d ON d.vec_id = s.document_id),
c AS (SELECT query_id, document_id, hit, {_COS.format(a='a', b='b')} AS s, {_COS.format(a='a[1:16]', b='b[1:16]')} AS t FROM p),
{_NCE.format(k=1, s='s')}, {_NCE.format(k=2, s='t')}
SELECT query_id, document_id, round(0.75::DOUBLE * l1.loss + 0.25::DOUBLE * l2.loss, 5) AS loss FROM l1 JOIN l2 USING (query_id, document_id)""")
def n3_truncated_info_nce(spark, d):
    e = load(spark, d, "embeddings")
    side = lambda x: e.select(F.col("vec_id").alias(f"{x}_id"), F.col("embedding").alias(f"{x}_vector"), F.col("label").alias(f"{x}_label"))
    pairs = _scored(spark, d).select("query_id", "document_id").join(side("query"), "query_id").join(side("document"), "document_id")
    scored = pairs.withColumn("relevance", F.when(F.col("query_label") == F.col("document_label"), 1).otherwise(-1))
    return tensors.truncated_info_nce(scored, 16, 0.25, 0.5).select("query_id", "document_id", F.round("loss", 5).alias("loss"))


@query("""WITH t AS (SELECT vec_id // 25 AS seq, vec_id % 25 AS pos, (vec_id % 25) // 4 AS own, embedding AS e FROM embeddings),
m AS (SELECT seq, own AS block, i, avg(x) AS m FROM (SELECT seq, own, unnest(range(0, 64)) AS i, unnest(e)::DOUBLE AS x FROM t) GROUP BY ALL),
k AS (SELECT seq, block, list(m ORDER BY i) AS mean FROM m GROUP BY ALL),
g AS (SELECT t.seq, pos, block, list_sum(list_transform(list_zip(e, mean), lambda z: z[1]::DOUBLE * z[2])) AS gate FROM t JOIN k ON k.seq = t.seq AND k.block < t.own)
SELECT seq, pos, block FROM (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY round(gate, 9) DESC, block) AS r FROM g) WHERE r < 3 UNION ALL SELECT seq, pos, own FROM t""")
def n10_block_gates(spark, d):
    e = load(spark, d, "embeddings")
    tokens = e.select(F.floor(F.col("vec_id") / 25).alias("seq"), (F.col("vec_id") % 25).alias("pos"), F.col("embedding").alias("q"), F.col("embedding").alias("k"))
    return tensors.block_gates(tokens, 4, 3)


@query("SELECT o_custkey, round(sum(6.0::DOUBLE * 1e9::DOUBLE * n + 12.0::DOUBLE * 2048 * 16 * n * n) / 1e12::DOUBLE, 4) AS tera_ops FROM (SELECT o_custkey, floor(o_totalprice / 1000)::DOUBLE AS n FROM orders) GROUP BY o_custkey")
def x25_training_ops(spark, d):
    packed = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.floor(F.col("o_totalprice") / 1000)).alias("lengths"))
    return packed.select("o_custkey", F.round(tensors.training_tera_ops(F.col("lengths"), 16, 2048, 10**9), 4).alias("tera_ops"))
