"""Queries of message records, token sequences, strings, responses and token losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions import messages as M
from lodestone.functions import sequences as S
from lodestone.functions import text as X
from lodestone.operators import evaluation
from lodestone.plans import requests
from lodestone.queries.text2sql import _generated

_IDS = "[p_partkey % 7, p_size, p_partkey % 11]"


def _ids(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array((F.col("p_partkey") % 7).cast("int"), "p_size", (F.col("p_partkey") % 11).cast("int")).alias("ids"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS content FROM conversations")
def a3_first_content(spark, d):
    turns = load(spark, d, "conversations")
    item = F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.col("role").alias("value"))
    return turns.select("conv_id", "turn", M.first_content(item, ("text", "value")).alias("content"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS contents, count(*)::BIGINT AS n FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def a1_f4_contents_of_role(spark, d):
    found = M.gather(load(spark, d, "conversations")).select("conv_id", M.contents_of(F.col("messages"), "user").alias("c"))
    return found.filter(F.size("c") > 0).select("conv_id", F.array_join("c", "\n").alias("contents"), F.size("c").cast("long").alias("n"))


@query("SELECT conv_id, count(*)::BIGINT + 1 AS n, 'assistant' AS last_role FROM conversations GROUP BY conv_id")
def a6_append_answer(spark, d):
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("content")))
    grown = M.gather(load(spark, d, "conversations")).select("conv_id", F.concat("messages", answer).alias("m"))
    return grown.select("conv_id", F.size("m").cast("long").alias("n"), F.element_at("m", -1)["role"].alias("last_role"))


@query("SELECT doc_id, 'user' AS role, md5(text) AS digest, lang FROM documents")
def a8_chat_record(spark, d):
    chat = load(spark, d, "documents").select("doc_id", "lang", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return chat.select("doc_id", F.col("messages")[0]["role"].alias("role"), F.md5(F.col("messages")[0]["content"]).alias("digest"), "lang")


@query(f"SELECT p_partkey, {_IDS} AS input_ids, {_IDS} AS labels FROM part")
def a13_unmasked_labels(spark, d):
    return _ids(spark, d).select("p_partkey", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [1] WHEN p_partkey % 3 = 1 THEN [2, 2] ELSE {_IDS} END AS output_ids FROM part")
def a14_output_ids(spark, d):
    k = F.col("p_partkey") % 3
    first, second = F.when(k == 0, F.array(F.lit(1))), F.when(k == 1, F.array(F.lit(2), F.lit(2)))
    return _ids(spark, d).select("p_partkey", S.first_given(first, second, F.col("ids")).alias("output_ids"))


@query("SELECT p_partkey, list_concat(list_transform(range(least(p_size, 20)), lambda x: 7), list_transform(range(20 - least(p_size, 20)), lambda x: 0)) AS input_ids FROM part")
def a16_collate(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.array_repeat(F.lit(7), F.col("p_size")).alias("ids"), F.lit(50).alias("longest"))
    return part.select("p_partkey", S.collate(F.col("ids"), F.col("longest"), 20, 0).alias("input_ids"))


@query("SELECT p_partkey, list_transform(range(50), lambda i: (i < p_size)::INT) AS mask FROM part")
def a17_attention_mask(spark, d):
    return load(spark, d, "part").select("p_partkey", S.attention_mask(F.col("p_size"), F.lit(50)).alias("mask"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS prompt_tokens FROM part")
def a18_boundary(spark, d):
    whole = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.slice("ids", 1, 2), F.array(F.lit(-1), F.lit(-2)))).otherwise(F.concat("ids", F.array(F.lit(-2))))
    return _ids(spark, d).select("p_partkey", M.boundary(F.col("ids"), whole).alias("prompt_tokens"))


@query("SELECT p_partkey, p_partkey % 7 = p_partkey % 11 OR p_partkey % 11 = p_size AS agree FROM part")
def a19_prompts_agree(spark, d):
    k = F.col("p_partkey")
    a = F.array((k % 7).cast("int"), (k % 11).cast("int"))
    b = F.array((k % 11).cast("int"), F.col("p_size"))
    return load(spark, d, "part").select("p_partkey", S.prompts_agree(a, b).alias("agree"))


@query(f"SELECT p_partkey, list_concat({_IDS}, [p_size]) AS input_ids, [-100, -100, -100, p_size] AS labels FROM part")
def a23_answer_labels(spark, d):
    part = _ids(spark, d).withColumn("answer", F.array(F.col("ids")[1]))
    return part.select("p_partkey", F.concat("ids", "answer").alias("input_ids"), S.answer_labels(F.col("ids"), F.col("answer")).alias("labels"))


@query("SELECT conv_id, 0 AS side, max(turn) AS last_turn FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 1, min(turn) FROM conversations GROUP BY conv_id")
def a24_preference_batch(spark, d):
    ends = load(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("chosen"), F.min("turn").alias("rejected"))
    return ends.select("conv_id", F.posexplode(F.array("chosen", "rejected")).alias("side", "last_turn"))


@query(f"SELECT p_partkey, list_concat([1], list_concat({_IDS}, [2])) AS input_ids FROM part")
def a25_causal_tokens(spark, d):
    return _ids(spark, d).select("p_partkey", F.concat(F.array(F.lit(1)), "ids", F.array(F.lit(2))).alias("input_ids"))


@query("SELECT p_partkey, [p_size, p_partkey % 11] AS shifted, [p_size, p_partkey % 11, -100] AS padded FROM part")
def a26_shifted_labels(spark, d):
    return _ids(spark, d).select("p_partkey", S.shifted(F.col("ids")).alias("shifted"), S.shifted(F.col("ids"), True).alias("padded"))


@query("SELECT p_partkey, i - 1 AS i, w[i] AS word FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part))")
def a27_explode_choices(spark, d):
    return load(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "word"))


@query("SELECT p_partkey, list_distinct_in_order AS words FROM (SELECT p_partkey, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1])[1:6] AS list_distinct_in_order FROM (SELECT p_partkey, list_concat(string_split(p_type, ' '), string_split(p_name, ' ')) AS w FROM part))")
def w20_t8_first_distinct_values(spark, d):
    words = F.concat(F.split("p_type", " "), F.split("p_name", " "))
    return load(spark, d, "part").select("p_partkey", F.slice(F.array_distinct(words), 1, 6).alias("words"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'SELECT ' || turn || ' FROM `t`;' ELSE '' END AS sql FROM conversations")
def x2_fenced_sql_or_empty(spark, d):
    made = _generated(spark, d).withColumn("m", F.when(F.col("turn") % 2 == 0, F.col("m")).otherwise("no code"))
    return made.select("conv_id", "turn", X.fenced_sql_or_empty(F.col("m")).alias("sql"))


@query("SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '[^a-zA-Z0-9_]') THEN '`' || n_name || '`' ELSE n_name END AS name, '`order`' AS word FROM nation")
def x5_quoted_identifiers(spark, d):
    words = X.sql_words(spark)
    return load(spark, d, "nation").select("n_nationkey", X.quoted(F.col("n_name"), words).alias("name"), X.quoted(F.lit("order"), words).alias("word"))


@query("""WITH v AS (SELECT n_nationkey, r_regionkey, lower(n_name) AS v, lower(r_name) AS q FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, r_regionkey, coalesce(max(k) / max(length(v))::DOUBLE, 0.0) AS ratio FROM (SELECT *, unnest(range(1, length(v) + 1)) AS i FROM v), LATERAL (SELECT unnest(range(0, length(v) - i + 2)) AS k) WHERE contains(q, substr(v, i, k)) GROUP BY ALL""")
def x6_common_substring(spark, d):
    pairs = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_nationkey", "r_regionkey", X.common_substring_ratio(F.col("n_name"), F.col("r_name")).alias("ratio"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '__MISSING_ID__' || substr(md5(text), 1, 16) ELSE doc_id::VARCHAR END AS id FROM documents")
def x11_x12_filled_ids(spark, d):
    given = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))
    return load(spark, d, "documents").select("doc_id", X.filled_id(given, F.col("text")).alias("id"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def x22_json_field(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS js FROM nation")
def x23_json_sorted_keys(spark, d):
    return load(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("js"))


@query("SELECT p_partkey, reverse(p_name) AS back, ends_with(p_type, 'BRASS') AS brass, regexp_replace(p_type, ' BRASS$', '') AS stem FROM part")
def x24_string_ends(spark, d):
    return load(spark, d, "part").select("p_partkey", F.reverse("p_name").alias("back"), F.endswith("p_type", F.lit("BRASS")).alias("brass"), F.regexp_replace("p_type", " BRASS$", "").alias("stem"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '!' ELSE '' END AS content FROM nation")
def x26_streamed_response(spark, d):
    chunk = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices"))))
    body = F.concat_ws("\n", chunk(F.col("n_name")), F.lit(""), chunk(F.lit("!")), F.lit("data: [DONE]"))
    return load(spark, d, "nation").select("n_nationkey", X.streamed_content(body, F.when(F.col("n_nationkey") % 2 == 0, 200).otherwise(500)).alias("content"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') > 1000 AS old FROM orders")
def x28_age_filter(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")) > 1000).alias("old"))


@query("""SELECT vec_id, round(embedding[label % 64 + 1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS log_prob FROM embeddings""")
def n4_label_log_prob(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(S.label_log_prob(F.col("embedding"), F.col("label") % 64), 6).alias("log_prob"))


@query("SELECT 't_' || conv_id || '_' || turn AS custom_id, text AS response FROM conversations WHERE turn % 3 <> 0")
def f8_answered(spark, d):
    custom = F.concat(F.lit("t_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("custom_id")
    made = load(spark, d, "conversations").select(custom, F.col("text").alias("response"), F.when(F.col("turn") % 3 == 0, "failed").alias("error"))
    sent = made.select("custom_id", F.to_json(F.struct("custom_id", "response")).alias("response"), "error")
    return requests.extracted(sent, "text").select("custom_id", F.col("choices")[0]["content"].alias("response"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND source <> ''")
def f5_verifiable(spark, d):
    good = load(spark, d, "labels").filter("quality = 1")
    return load(spark, d, "documents").filter("source <> ''").select("doc_id").join(good.select("doc_id"), "doc_id", "left_semi")


@query("SELECT item, right_n, wrong_n FROM (SELECT user_id AS item, count(*) FILTER (value > 50)::BIGINT AS right_n, count(*) FILTER (NOT value > 50)::BIGINT AS wrong_n FROM events GROUP BY 1) WHERE right_n > 0 AND wrong_n > 0")
def f9_f10_right_and_wrong(spark, d):
    return evaluation.right_and_wrong(load(spark, d, "events").select(F.col("user_id").alias("item"), (F.col("value") > 50).alias("correct")))
