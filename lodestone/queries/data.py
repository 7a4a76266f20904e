"""Queries of the data engine: sources, row maps, sampling, packing, messages, preference pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions import messages as M
from lodestone.functions import text as X
from lodestone.operators import metrics, packing, position
from lodestone.plans import requests
from lodestone.sources.registry import resolve

_KEY = "('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT"
_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
_POS = "row_number() OVER (ORDER BY doc_id) - 1"
_MSG = "string_agg(role || ':' || text, chr(10) ORDER BY turn)"


def _lengths(spark, d):
    docs = load(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("length"))
    return position.with_position(docs, "doc_id")


def _chats(spark, d):
    return M.gather(load(spark, d, "conversations"))


def _joined(m):
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")


@query("SELECT text FROM documents")
def s7_text_column(spark, d):
    return resolve({"type": "text", "name": f"{d}/documents.parquet"}).load(spark)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def s12_sql_source(spark, d):
    load(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    text = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"
    return resolve({"type": "sql", "options": {"sql": text}}).load(spark)


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def s16_column_mapping(spark, d):
    load(spark, d, "region").select("r_regionkey", "r_name").createOrReplaceTempView("region_names")
    return resolve({"type": "sql", "options": {"table_name": "region_names", "column_mapping": {"r_regionkey": "id", "r_name": "name"}}}).load(spark)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10 OFFSET 10")
def s5_slice_split(spark, d):
    return resolve({"type": "files", "name": f"{d}/documents.parquet", "split": "train[10:20]"}).load(spark).select("doc_id", "lang")


@query(f"WITH p AS (SELECT doc_id, {_POS} AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, (pos // 64)::BIGINT AS batch_id FROM p WHERE pos < n - n % 64")
def s20_chunked_scan(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    n = docs.count()
    return docs.filter(F.col("pos") < n - n % 64).select("doc_id", F.floor(F.col("pos") / 64).alias("batch_id"))


@query("SELECT doc_id, substr(text, 1, 8 * 16) AS text FROM documents")
def x14_pre_truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring("text", 1, 8 * 16).alias("text"))


@query("SELECT doc_id, md5('passage: ' || text) AS digest FROM documents")
def p10_prefix(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("passage: "), "text")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN trim(source) IN ('', '-') THEN text ELSE source || chr(10) || text END) AS digest FROM documents")
def p7_title_and_body(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(X.title_and_body(F.col("source"), F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, {_WORDS}::BIGINT AS n_tokens FROM documents")
def x15_token_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(X.token_ids(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, {_WORDS}::BIGINT AS n_tokens FROM documents WHERE {_WORDS} <= 512")
def f1_length_filter(spark, d):
    n = X.token_count(F.col("text"))
    return load(spark, d, "documents").select("doc_id", n.alias("n_tokens")).filter("n_tokens <= 512")


@query(f"SELECT count(*)::BIGINT AS n_rows, sum({_WORDS})::BIGINT AS n_tokens FROM documents")
def g1_totals(spark, d):
    return load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(X.token_count(F.col("text"))).alias("n_tokens"))


@query(f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, pos::BIGINT AS pos FROM p WHERE pos < floor(n * 0.3)")
def w8_exact_sample(spark, d):
    return position.sample_exact(load(spark, d, "documents").select("doc_id"), "doc_id", ratio=0.3)


@query(f"SELECT doc_id, (row_number() OVER (ORDER BY {_KEY}, doc_id) - 1)::BIGINT AS pos FROM documents")
def w9_global_shuffle(spark, d):
    return position.shuffled_position(load(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < ceil(n * 0.1) THEN 'eval' ELSE 'train' END AS split FROM p")
def w10_train_eval_split(spark, d):
    return position.split_exact(load(spark, d, "documents").select("doc_id"), "doc_id", 0.1).select("doc_id", "split")


@query(f"""WITH p AS (SELECT doc_id, {_POS} AS pos, count(*) OVER () AS n FROM documents),
w AS (SELECT doc_id, pos, n, (n + 6) // 7 AS per FROM p),
c AS (SELECT doc_id, pos AS place, per FROM w UNION ALL SELECT doc_id, pos + n, per FROM w WHERE pos < per * 7 - n)
SELECT doc_id, (place % 7)::INT AS rank, (place // 7 // 4)::BIGINT AS batch FROM c WHERE place // 7 // 4 < per // 4""")
def w11_rank_assignment(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    return position.assign_ranks(docs, 7, 4, docs.count()).select("doc_id", "rank", "batch")


@query(f"""WITH p AS (SELECT doc_id, {_POS} AS pos, count(*) OVER () // 10 AS c FROM documents),
s AS (SELECT doc_id, pos, c // 3 AS e, c % 3 AS x FROM p),
b AS (SELECT doc_id, pos, ((e + (x > 0)::INT) * 10) AS b1, ((2 * e + (x > 0)::INT + (x > 1)::INT) * 10) AS b2, ((3 * e + x) * 10) AS b3 FROM s)
SELECT doc_id, (CASE WHEN pos < b1 THEN 0 WHEN pos < b2 THEN 1 ELSE 2 END)::INT AS shard FROM b WHERE pos < b3""")
def w12_shard_slices(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    bounds = position.shard_slices(docs.count(), 10, 3)
    shard = F.lit(None).cast("int")
    for i, (a, z) in enumerate(bounds):
        shard = F.when((F.col("pos") >= a) & (F.col("pos") < z), F.lit(i)).otherwise(shard)
    return docs.select("doc_id", shard.alias("shard")).filter("shard IS NOT NULL")


@query(f"SELECT doc_id, (({_POS}) % 5)::INT AS replica FROM documents")
def w15_round_robin(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    return docs.select("doc_id", (F.col("pos") % 5).cast("int").alias("replica"))


def _next_fit_sql(always: str) -> str:
    return f"""WITH RECURSIVE t AS (SELECT ({_POS}) AS pos, {_WORDS} AS length FROM documents),
r AS (SELECT pos // 100 AS chunk, pos, length FROM t),
f AS (SELECT chunk, pos, 0 AS pack, length AS used FROM r WHERE pos % 100 = 0
  UNION ALL SELECT r.chunk, r.pos, f.pack + (f.used > 2048 OR {always})::INT, CASE WHEN f.used > 2048 OR {always} THEN r.length ELSE f.used + r.length END
  FROM f JOIN r ON r.chunk = f.chunk AND r.pos = f.pos + 1)
SELECT chunk::BIGINT AS chunk, pos::BIGINT AS pos, pack::INT AS pack FROM f"""


@query(_next_fit_sql("f.used + r.length > 2048"))
def w1_next_fit(spark, d):
    rows = _lengths(spark, d).withColumn("chunk", position.chunk_of(100))
    return packing.next_fit(rows.select("chunk", "pos", "length"), 2048).select("chunk", "pos", "pack")


@query(_next_fit_sql("false"))
def w1_next_fit_always_max(spark, d):
    rows = _lengths(spark, d).withColumn("chunk", position.chunk_of(100))
    return packing.next_fit(rows.select("chunk", "pos", "length"), 2048, always_max_length=True).select("chunk", "pos", "pack")


@query(f"""WITH t AS (SELECT ({_POS}) AS pos, {_WORDS} AS n FROM documents),
r AS (SELECT pos // 100 AS chunk, pos, n, n // 256 AS k, n % 256 AS tail FROM t WHERE n > 0),
o AS (SELECT *, coalesce(sum(tail) OVER (PARTITION BY chunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(tail) OVER (PARTITION BY chunk) AS total FROM r),
f AS (SELECT chunk, pos, 'full' AS kind, i AS pack, i * 256 AS first, 256 AS n FROM (SELECT chunk, pos, unnest(range(0, k)) AS i FROM r)),
x AS (SELECT *, unnest(range(off::BIGINT // 256, (off + tail - 1)::BIGINT // 256 + 1)) AS pack FROM o WHERE tail > 0),
y AS (SELECT chunk, pos, 'tail' AS kind, pack, k * 256 + greatest(off, pack * 256) - off AS first, least(off + tail, (pack + 1) * 256) - greatest(off, pack * 256) AS n FROM x WHERE (pack + 1) * 256 <= total)
SELECT chunk::BIGINT AS chunk, pos::BIGINT AS pos, kind, pack::BIGINT AS pack, first::BIGINT AS first, n::BIGINT AS n FROM f UNION ALL SELECT chunk, pos, kind, pack, first, n FROM y""")
def w2_slice_and_pack(spark, d):
    rows = _lengths(spark, d).withColumn("chunk", position.chunk_of(100))
    return packing.slice_and_pack(rows.select("chunk", "pos", "length"), 256)


@query(f"WITH t AS (SELECT doc_id, {_WORDS} AS n FROM documents) SELECT doc_id, i::BIGINT AS segment FROM (SELECT doc_id, unnest(range(0, n // 64)) AS i FROM t)")
def w27_prompt_segments(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.floor(X.token_count(F.col("text")) / 64).alias("k")).filter("k > 0")
    return rows.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("segment"))


@query("SELECT source, count(*)::BIGINT AS n FROM (SELECT * FROM documents WHERE lang = 'en' UNION ALL SELECT * FROM documents WHERE lang = 'de') GROUP BY source")
def t4_concatenate(spark, d):
    docs = load(spark, d, "documents")
    return docs.filter("lang = 'en'").unionByName(docs.filter("lang = 'de'")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def g3_distinct_keep_first(spark, d):
    return load(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents")
def j6_canonical_ids(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("kept")), "h").select("doc_id", "kept")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j5_anti_join(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j3_key_intersection(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("""SELECT md5(array_to_string(list_transform(list_filter([['system', source], ['user', lang], ['assistant', text]], lambda m: m[2] IS NOT NULL), lambda m: m[1] || ':' || m[2]), chr(10))) AS digest
FROM documents WHERE source IS NOT NULL OR lang IS NOT NULL OR text IS NOT NULL""")
def s8_messages(spark, d):
    roles = {"system": "source", "user": "lang", "assistant": "text"}
    chats = resolve({"type": "instruct", "name": f"{d}/documents.parquet", "options": {"role_fields": roles}}).load(spark)
    return chats.select(F.md5(_joined(F.col("messages"))).alias("digest"))


@query("SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def a2_conversation_filter(spark, d):
    return _chats(spark, d).select("conv_id", M.contents_of(F.col("messages"), "user").alias("texts")).filter(F.size("texts") > 0)


@query("""WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations WHERE text <> ''),
k AS (SELECT conv_id, min(n) AS k FROM (SELECT conv_id, role, count(*) AS n FROM r GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY i, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END)) AS digest, count(*)::BIGINT AS n FROM r JOIN k USING (conv_id) WHERE i <= k GROUP BY conv_id""")
def a4_role_zip(spark, d):
    zipped = _chats(spark, d).select("conv_id", M.role_zip(F.col("messages")).alias("m"))
    return zipped.select("conv_id", F.md5(_joined(F.col("m"))).alias("digest"), F.size("m").cast("long").alias("n"))


@query("SELECT conv_id, min_by(text, turn) AS first_text, max_by(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def a7_first_and_last(spark, d):
    m = _chats(spark, d).select("conv_id", M.first_and_last(F.col("messages")).alias("m"))
    return m.select("conv_id", F.col("m")[0]["content"].alias("first_text"), F.col("m")[1]["content"].alias("last_text"))


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
l AS (SELECT conv_id, turn AS cut FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') WHERE r = 1)
SELECT c.conv_id, min(CASE WHEN c.turn = l.cut THEN i ELSE n END)::INT AS prefix FROM c LEFT JOIN l USING (conv_id) GROUP BY c.conv_id""")
def a9_common_prefix(spark, d):
    chats = _chats(spark, d)
    last = F.array_max(F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull()))
    changed = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == F.col("last"), F.concat(m["content"], F.lit(" no"))).otherwise(m["content"]).alias("content")))
    pairs = chats.withColumn("last", last).withColumn("rejected", changed)
    return pairs.select("conv_id", M.common_prefix(F.col("messages"), F.col("rejected")).alias("prefix"))


@query("SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def x16_chat_template(spark, d):
    return _chats(spark, d).select("conv_id", F.md5(M.chat_text(F.col("messages"))).alias("digest"))


@query("SELECT 'user' AS role, md5(text) AS digest FROM documents")
def s10_single_user_message(spark, d):
    chats = resolve({"type": "user_text", "name": f"{d}/documents.parquet"}).load(spark)
    return chats.select(F.col("messages")[0]["role"].alias("role"), F.md5(F.col("messages")[0]["content"]).alias("digest"))


@query("SELECT conv_id, turn, (strpos(text, 'the') - 1)::INT AS place FROM conversations")
def a11_find_content(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", M.find_content(F.col("text"), F.lit("the")).alias("place"))


@query(r"SELECT conv_id, turn, md5(regexp_replace('<think> ' || chr(10) || '</think>' || chr(10) || text, '^<think>\s*</think>\s*', '')) AS digest FROM conversations")
def a12_strip_empty_think(spark, d):
    wrapped = F.concat(F.lit("<think> \n</think>\n"), "text")
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(M.strip_empty_think(wrapped)).alias("digest"))


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, len(ids) AS n FROM s)
SELECT l_orderkey, list_concat(ids, list_transform(range(n, ceil(n / 4.0)::BIGINT * 4), lambda x: 0)) AS padded, list_concat(list_transform(range(0, n), lambda x: 1), list_transform(range(n, ceil(n / 4.0)::BIGINT * 4), lambda x: 0)) AS mask FROM m""")
def a15_pad_to_multiple(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    size = (F.ceil(F.size("ids") / 4) * 4).cast("int")
    ones = F.array_repeat(F.lit(1), F.size("ids"))
    return rows.select("l_orderkey", M.pad(F.col("ids"), size, 0).alias("padded"), M.pad(ones, size, 0).alias("mask"))


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN ids[1] = 1 THEN ids ELSE list_prepend(1, ids) END AS with_bos,
CASE WHEN len(ids) >= 2 AND ids[len(ids) - 1] = 3 THEN ids[1:len(ids) - 1] WHEN ids[len(ids)] = 3 THEN ids ELSE list_append(ids, 3) END AS with_eos FROM s""")
def a20_a21_bos_eos(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return rows.select("l_orderkey", M.with_bos(F.col("ids"), 1).alias("with_bos"), M.with_eos(F.col("ids"), 3).alias("with_eos"))


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN ids[i] % 3 = 1 OR (i > 1 AND ids[i - 1] % 3 = 1) THEN ids[i] ELSE -100 END) AS labels FROM s""")
def a10_label_mask(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    inside = rows.withColumn("inside", F.transform("ids", lambda x: x % 3 == 1))
    return inside.select("l_orderkey", M.mask_labels(F.col("ids"), F.col("inside")).alias("labels"))


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS p FROM lineitem GROUP BY l_orderkey),
t AS (SELECT l_orderkey, p, len(p) > 1 AND 2 * len(p) > 6 AS over FROM s),
u AS (SELECT *, CASE WHEN 2 * len(p) > 6 THEN p[1:2] ELSE p END AS prompt FROM t)
SELECT l_orderkey, prompt, CASE WHEN len(prompt) + len(p) > 6 THEN p[1:4] ELSE p END AS answer FROM u""")
def a22_pair_truncation(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("p"))
    prompt, chosen, _ = M.pair_truncation(F.col("p"), F.col("p"), F.col("p"), 6, 2)
    return rows.select("l_orderkey", prompt.alias("prompt"), chosen.alias("answer"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_concat(range(0, n), range(0, 2)) AS ids FROM s""")
def w4_position_ids(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("l_orderkey", packing.position_ids(F.array(F.col("n"), F.lit(2).cast("long"))).cast("array<bigint>").alias("ids"))


@query("SELECT 'chat_' || conv_id || '_' || turn AS custom_id, text AS content, CASE WHEN turn % 4 = 0 THEN role ELSE 'assistant' END AS role FROM conversations")
def y5_extract_responses(spark, d):
    said, own = F.col("text"), F.array
    bodies = {
        "chat": F.struct(F.struct(own(F.struct(F.struct(said.alias("content"), F.col("role")).alias("message"))).alias("choices")).alias("body")),
        "complete": F.struct(own(F.struct(said.alias("messages"))).alias("choices")),
        "outputs": F.struct(own(F.struct(said.alias("text"))).alias("outputs")),
        "text": said,
    }
    turns = load(spark, d, "conversations").withColumn("custom_id", F.concat(F.lit("chat_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    read = []
    for i, (shape, body) in enumerate(bodies.items()):
        sent = turns.filter(F.col("turn") % 4 == i).select("custom_id", F.to_json(F.struct("custom_id", body.alias("response"))).alias("response"), F.lit(None).cast("string").alias("error"))
        read.append(requests.extracted(sent, shape))
    return reduce(DataFrame.unionByName, read).select("custom_id", F.inline("choices")).select("custom_id", "content", "role")


@query("SELECT 'task_' || (row_number() OVER (ORDER BY doc_id) - 1) AS custom_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::BIGINT AS file FROM documents")
def y2_k10_request_files(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id"), "doc_id")
    return docs.select(F.concat(F.lit("task_"), F.col("pos").cast("string")).alias("custom_id"), F.floor(F.col("pos") / 300).alias("file"))


@query("SELECT 'task_' || conv_id || '_' || turn AS custom_id, turn AS n FROM conversations")
def x21_custom_id_number(spark, d):
    ids = load(spark, d, "conversations").select(F.concat(F.lit("task_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("custom_id"))
    return ids.select("custom_id", X.custom_id_number(F.col("custom_id")).alias("n"))


@query("SELECT custom_id, row_number() OVER (ORDER BY custom_id) AS place FROM (SELECT DISTINCT 't_' || conv_id AS custom_id FROM conversations)")
def w29_sort_by_string_id(spark, d):
    ids = load(spark, d, "conversations").select(F.concat(F.lit("t_"), F.col("conv_id").cast("string")).alias("custom_id")).distinct()
    return position.with_position(ids, "custom_id").select("custom_id", (F.col("pos") + 1).alias("place"))


@query("SELECT event_type, avg(value) AS mean_value, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def g15_metric_means(spark, d):
    return metrics.means(load(spark, d, "events").select(F.col("event_type").alias("dataset"), "value")).withColumnsRenamed({"dataset": "event_type", "mean": "mean_value"})


@query("SELECT (event_id // 8)::BIGINT AS step, avg(value) AS loss FROM events GROUP BY 1")
def g14_windowed_loss(spark, d):
    return metrics.windowed(load(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss")), 8)


@query("SELECT event_id, (CASE WHEN event_id < 100 THEN event_id / 100.0 WHEN event_id < 9000 THEN 1.0 ELSE greatest(0.0, (10000 - event_id) / 1000.0) END)::DOUBLE AS rate FROM events")
def n12_warmup_stable_decay(spark, d):
    return load(spark, d, "events").select("event_id", metrics.warmup_stable_decay(F.col("event_id"), 100, 9000, 10_000).alias("rate"))


@query("SELECT event_id, ts FROM events WHERE (event_id + 1) % 50 = 0")
def v18_every_n_steps(spark, d):
    return load(spark, d, "events").filter(metrics.every(F.col("event_id"), 50)).select("event_id", "ts")


@query("""SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS ends FROM lineitem""")
def t9_cumulative_offsets(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_linenumber").over(w).alias("ends"))
