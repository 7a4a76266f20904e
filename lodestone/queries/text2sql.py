"""Queries of text-to-SQL data, synthetic-data requests and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions import text as X
from lodestone.functions.prompts import filled
from lodestone.operators import evaluation as E
from lodestone.operators import lexical
from lodestone.plans.scratch import new_path

_GEN = "'Here' || chr(10) || '```sql' || chr(10) || 'SELECT ' || turn || ' FROM `t`;' || chr(10) || '```' || chr(10) || 'end'"


def _generated(spark, d):
    m = F.concat(F.lit("Here\n```sql\nSELECT "), F.col("turn").cast("string"), F.lit(" FROM `t`;\n```\nend"))
    return load(spark, d, "conversations").select("conv_id", "turn", m.alias("m"))


@query("SELECT conv_id, turn, 'SELECT ' || turn || ' FROM `t`;' AS sql FROM conversations")
def x1_fenced_sql(spark, d):
    return _generated(spark, d).select("conv_id", "turn", X.fenced_sql(F.col("m")).alias("sql"))


@query("SELECT conv_id, turn, 'SELECT ' || turn || ' FROM \"t\"' AS sql FROM conversations")
def x3_clean_sql(spark, d):
    return _generated(spark, d).select("conv_id", "turn", X.clean_sql(X.fenced_sql(F.col("m"))).alias("sql"))


@query("SELECT conv_id, turn, 'SELECT ' || turn AS sql FROM conversations")
def x4_comment_removal(spark, d):
    c = F.concat(F.lit("SELECT /* all\n of it */"), F.col("turn").cast("string"), F.lit(" -- done"))
    return load(spark, d, "conversations").select("conv_id", "turn", X.without_comments(c).alias("sql"))


@query("SELECT p_partkey, '[ BLOB ] () ' || p_name AS text FROM part")
def x8_redact_blobs(spark, d):
    return load(spark, d, "part").select("p_partkey", X.redact_blobs(F.concat(F.lit("[ BLOB ] (0x"), F.hex("p_partkey"), F.lit(") "), "p_name")).alias("text"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)
SELECT DISTINCT p_partkey, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT p_partkey, w, unnest(range(1, 9)) AS k FROM w), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)""")
def x7_word_ngrams(spark, d):
    return load(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(X.ngrams(F.split("p_type", " "), 8))).alias("gram"))


@query("SELECT l.quality AS bucket, d.lang, count(*)::BIGINT AS n, avg(l.quality) AS accuracy FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def g7_accuracy_by_bucket(spark, d):
    both = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    return both.groupBy(F.col("quality").alias("bucket"), "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("accuracy"))


@query("SELECT event_type AS bucket, count(*)::BIGINT AS n, avg((value > 50)::INT) AS accuracy, avg((event_id % 5 <> 0)::INT) AS executed FROM events GROUP BY event_type")
def g8_execution_accuracy(spark, d):
    return E.accuracy(_samples(spark, d), "bucket")


_SAMPLES = "s AS (SELECT user_id AS item, event_type, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"


def _samples(spark, d):
    """Events as samples of their user's item: correct above 50, every fifth failed."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    failed = F.when(F.col("event_id") % 5 == 0, "failed")
    return load(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("bucket"), "event_id", pos.alias("pos"), (F.col("value") > 50).alias("correct"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("answer"), failed.alias("error"), F.floor("value").cast("long").alias("n_rows"))


@query(f"WITH {_SAMPLES} SELECT avg(hit::INT) AS pass_at_k FROM (SELECT item, coalesce(bool_or(value > 50) FILTER (pos < 3), false) AS hit FROM s GROUP BY item)")
def g9_pass_at_k(spark, d):
    return E.pass_at(_samples(spark, d), 3)


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND floor(value) > 0")
def f12_valid_executions(spark, d):
    return E.valid_executions(_samples(spark, d)).select("event_id")


@query("SELECT user_id AS item, min_by(event_type || '-' || event_id, event_id) AS answer FROM events WHERE value > 50 GROUP BY user_id")
def q12_first_correct(spark, d):
    return E.first_correct(_samples(spark, d))


@query("""WITH c AS (SELECT event_id % 7 AS checkpoint, count(*)::BIGINT AS n, avg((value > 50)::INT) AS accuracy, avg((event_id % 5 <> 0)::INT) AS executed FROM events GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY accuracy DESC, checkpoint) = 1 AS best FROM c""")
def q14_checkpoint_sweep(spark, d):
    return E.checkpoint_sweep(_samples(spark, d).withColumn("checkpoint", F.col("event_id") % 7))


@query("""WITH c AS (SELECT user_id AS item, event_type AS result, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT item, result FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def g10_majority_vote(spark, d):
    return E.majority(load(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), F.col("event_type").alias("result")))


@query("""WITH a AS (SELECT l_suppkey AS item, l_returnflag AS value, count(*) AS a FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
b AS (SELECT l_suppkey AS item, l_returnflag AS value, count(*) AS b FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL)
SELECT item, sum(least(coalesce(a, 0), coalesce(b, 0))) / sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS similarity FROM a FULL JOIN b USING (item, value) GROUP BY item""")
def g12_soft_similarity(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.lit("flag").alias("name"), F.col("l_returnflag").alias("value"), "l_linenumber")
    return E.soft_similarity(rows.filter("l_linenumber % 2 = 0").drop("l_linenumber"), rows.filter("l_linenumber % 2 = 1").drop("l_linenumber"), ["item"])


@query("""WITH x AS (SELECT p_size || '|' || p_brand AS item, p_partkey, p_type AS a, p_retailprice >= (SELECT median(p_retailprice) FROM part) AS good FROM part)
SELECT item, c.a AS chosen, w.a AS rejected FROM (SELECT item, c, w, row_number() OVER (PARTITION BY item ORDER BY levenshtein(c.a, w.a), c.p_partkey, w.p_partkey) AS r FROM (SELECT item, struct_pack(p_partkey, a) AS c FROM x WHERE good) JOIN (SELECT item, struct_pack(p_partkey, a) AS w FROM x WHERE NOT good) USING (item)) WHERE r = 1""")
def q11_nearest_pair(spark, d):
    part = load(spark, d, "part")
    middle = part.agg(F.median("p_retailprice")).scalar()
    marked = part.select(F.concat_ws("|", F.col("p_size").cast("string"), "p_brand").alias("item"), "p_partkey", "p_type", (F.col("p_retailprice") >= middle).alias("good"))
    listed = lambda good: F.transform(F.array_sort(F.collect_list(F.when(F.col("good") == good, F.struct("p_partkey", "p_type")))), lambda x: x["p_type"])
    return E.nearest_pair(marked.groupBy("item").agg(listed(True).alias("correct"), listed(False).alias("wrong")))


@query("SELECT DISTINCT p_name AS value FROM part WHERE p_name <> '' AND try_cast(p_name AS DOUBLE) IS NULL AND length(p_name) <= 40 UNION SELECT DISTINCT c_mktsegment FROM customer")
def f7_value_filter(spark, d):
    values = load(spark, d, "part").select(F.col("p_name").alias("value")).unionByName(load(spark, d, "customer").select(F.col("c_mktsegment").alias("value")))
    return lexical.index_values(values)


@query("""SELECT p_brand, value FROM (SELECT p_brand, value, row_number() OVER (PARTITION BY p_brand ORDER BY value) AS r FROM (SELECT DISTINCT p_brand, substr(p_type || ' ' || p_type || ' ' || p_name, 1, 40) AS value FROM part)) WHERE r <= 2""")
def q4_value_sample(spark, d):
    part = load(spark, d, "part")
    return lexical.value_sample(part.select("p_brand", F.concat_ws(" ", "p_type", "p_type", "p_name").alias("value")), "p_brand", 2)


_PAIRS = [
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT DISTINCT n_name FROM nation"),
    ("SELECT n_name FROM nation WHERE n_regionkey < 2", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2"),
    ("SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000"),
    ("SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey", "SELECT o_orderkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"),
    ("SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0"),
]


@query(" UNION ALL ".join(
    f"SELECT {i} AS pair, {rule}(SELECT count(*) FROM ((SELECT * FROM ({a})) EXCEPT (SELECT * FROM ({b})))) + (SELECT count(*) FROM ((SELECT * FROM ({b})) EXCEPT (SELECT * FROM ({a})))) = 0 AS same, {empty} AS empty_matches"
    for i, (a, b) in enumerate(_PAIRS) for empty, rule in (("true", ""), ("false", f"(SELECT count(*) FROM ({a})) > 0 AND "))
))
def q10_execution_match(spark, d):
    for t in ("nation", "region", "orders", "lineitem"):
        load(spark, d, t).createOrReplaceTempView(t)
    rows = [(i, E.execution_match(spark, a, b, 120.0, empty)[0], empty) for i, (a, b) in enumerate(_PAIRS) for empty in (True, False)]
    return spark.createDataFrame(rows, "pair int, same boolean, empty_matches boolean")


#: What generated statements do over the customers of a nation, and whether that is allowed.
_STATEMENTS = [
    ("SELECT count(*) FROM customer WHERE c_nationkey = {k}", True),
    ("SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir'), {k}", False),
    ("WITH c AS (SELECT * FROM customer WHERE c_nationkey = {k}) SELECT count(*) FROM c WHERE c_name <> 'reflect (x)' -- java_method(", True),
    ("SELECT reflect/**/('java.lang.System', 'getenv'), {k}", False),
    ("SELECT count(*) FROM parquet.`/{k}`", False),
    ("SELECT count(*) FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = {k})", True),
    ("DROP VIEW customer -- {k}", False),
]


@query("SELECT n_nationkey AS statement_id, n_nationkey % 7 IN (1, 3, 4, 6) AS refused, CASE n_nationkey % 7 WHEN 5 THEN count(DISTINCT c_mktsegment) WHEN 0 THEN count(c_custkey) WHEN 2 THEN count(c_custkey) END AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def q7_guarded_statements(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("customer")
    key = F.col("n_nationkey")
    sql = F.lit(None).cast("string")
    for i, (text, _) in enumerate(_STATEMENTS):
        sql = F.when(key % len(_STATEMENTS) == i, F.replace(F.lit(text), F.lit("{k}"), key.cast("string"))).otherwise(sql)
    done = E.run_statements(spark, load(spark, d, "nation").select(key.alias("statement_id"), sql.alias("sql")), seconds=60.0)
    rows = [(key, bool(error and error.startswith("not a query")), rows[0][0] if rows else None) for key, rows, error in done]
    return spark.createDataFrame(rows, "statement_id int, refused boolean, n long")


@query("""WITH g AS (SELECT r_regionkey AS item, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND r_regionkey <> 4) > 0 AS held FROM region)
SELECT item, CASE WHEN held THEN [0, 3] ELSE [] END::INT[] AS correct, CASE WHEN held THEN [1, 2, 4, 5] ELSE [0, 1, 2, 3, 4, 5] END::INT[] AS wrong FROM g""")
def q8_verified_answers(spark, d):
    """A gold statement a region (one of them empty) and six answers: right, another region's, null, right in other words, failing, refused."""
    load(spark, d, "nation").createOrReplaceTempView("nation")
    key = F.col("r_regionkey").cast("string")
    text = lambda s: F.replace(F.lit(s), F.lit("{k}"), key)
    answers = F.array(
        text("SELECT n_name FROM nation WHERE n_regionkey = {k} AND {k} <> 4 ORDER BY n_name DESC"), text("SELECT n_name FROM nation WHERE n_regionkey = ({k} + 1) % 5"), F.lit(None).cast("string"),
        text("SELECT upper(n_name) FROM (SELECT DISTINCT n_name FROM nation WHERE n_regionkey + 1 = {k} + 1 AND {k} < 4)"), text("SELECT none_such FROM nation"), text("DROP VIEW nation"),
    )
    items = load(spark, d, "region").select(F.col("r_regionkey").alias("item"), text("SELECT n_name FROM nation WHERE n_regionkey = {k} AND {k} <> 4").alias("gold"), answers.alias("answers"))
    return spark.createDataFrame(list(E.verify_answers(spark, items, 120.0)), "item int, correct array<int>, wrong array<int>")


@query("SELECT p_partkey, 'Q: ' || p_name || chr(10) || 'E: ' || p_type AS prompt FROM part")
def p8_question_and_evidence(spark, d):
    return load(spark, d, "part").select("p_partkey", filled("Q: {question}\nE: {evidence}", question=F.col("p_name"), evidence=F.col("p_type")).alias("prompt"))


@query("""WITH v AS (SELECT min(p_partkey) AS p_partkey, p_type AS value FROM part GROUP BY p_type),
t AS (SELECT p_partkey, unnest(string_split(lower(value), ' ')) AS term FROM v), n AS (SELECT count(*) AS n FROM v),
f AS (SELECT term, count(DISTINCT p_partkey) AS df FROM t GROUP BY term), q AS (SELECT DISTINCT s_suppkey AS q, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) AS term FROM supplier JOIN part ON p_partkey = s_suppkey),
l AS (SELECT p_partkey, count(*) AS len FROM t GROUP BY p_partkey), a AS (SELECT avg(len) AS avg_len FROM l),
c AS (SELECT p_partkey, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT q.q, c.p_partkey, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score
  FROM q JOIN c USING (term) JOIN f USING (term) JOIN l USING (p_partkey), n, a GROUP BY ALL)
SELECT q, p_partkey, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, p_partkey) AS r FROM s) WHERE r <= 10""")
def q6_bm25_values(spark, d):
    part = load(spark, d, "part")
    values = part.groupBy("p_type").agg(F.min("p_partkey").alias("value_id")).select("value_id", F.split(F.lower("p_type"), " ").alias("terms"))
    question = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    asked = load(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("q"), question.alias("terms"))
    index = lexical.build_index(values, new_path(spark, "value-index"))
    return lexical.bm25(asked, index, 10).select("q", F.col("value_id").alias("p_partkey"), F.round("score", 5).alias("score"))


_BM25 = """n AS (SELECT count(*) AS n FROM v), t AS (SELECT value_id, unnest(string_split(lower(value), ' ')) AS term FROM v),
f AS (SELECT term, count(DISTINCT value_id) AS df FROM t GROUP BY term), l AS (SELECT value_id, count(*) AS len FROM t GROUP BY value_id), a AS (SELECT avg(len) AS avg_len FROM l),
c AS (SELECT value_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT q.q, c.value_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score
  FROM q JOIN c USING (term) JOIN f USING (term) JOIN l USING (value_id), n, a GROUP BY ALL),
h AS (SELECT q, value_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, value_id) AS r FROM s) WHERE r <= 10)"""


def _values(spark, d):
    """Names and types of parts by their least key, types above all names."""
    part = load(spark, d, "part")
    named = part.groupBy(F.col("p_name").alias("value")).agg(F.min("p_partkey").alias("value_id"))
    typed = part.groupBy(F.col("p_type").alias("value")).agg((F.min("p_partkey") + 1_000_000_000).alias("value_id"))
    return named.unionByName(typed).select("value_id", F.split(F.lower("value"), " ").alias("terms"))


_VALUES = "v AS (SELECT min(p_partkey) AS value_id, p_name AS value FROM part GROUP BY p_name UNION ALL SELECT min(p_partkey) + 1000000000, p_type FROM part GROUP BY p_type)"


@query(f"""WITH {_VALUES}, w AS (SELECT s_suppkey, string_split(lower(p_type || ' ' || p_name), ' ') AS w FROM supplier JOIN part ON p_partkey = s_suppkey),
g AS (SELECT DISTINCT s_suppkey, array_to_string(w[i:i + k - 1], ' ') AS q FROM (SELECT s_suppkey, w, unnest(range(1, 9)) AS k FROM w), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
q AS (SELECT DISTINCT q, unnest(string_split(q, ' ')) AS term FROM g), {_BM25}
SELECT s_suppkey, value_id, round(max(score), 5) AS score FROM g JOIN h USING (q) GROUP BY ALL""")
def j10_ngrams_to_values(spark, d):
    part = load(spark, d, "part")
    question = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    asked = load(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("question"), X.ngrams(question, 8).alias("grams"))
    index = lexical.build_index(_values(spark, d), new_path(spark, "gram-index"))
    return lexical.gram_hits(asked, index, 10).select(F.col("question").alias("s_suppkey"), "value_id", F.round("score", 5).alias("score"))
