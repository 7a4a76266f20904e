"""Queries of whole steps: sources, tokenised and packed training data, schemas, prompts, requests, exchange."""

from __future__ import annotations

import json
import sqlite3
import tempfile
from contextlib import closing

from pyspark.sql import functions as F

from lodestone.catalog import load, query
from lodestone.functions import messages as M
from lodestone.functions import prompts
from lodestone.functions import text as X
from lodestone.functions.tokenizer import HashTokenizer
from lodestone.operators import embedding, packing, position
from lodestone.operators import relational as R
from lodestone.operators.metrics import Stages
from lodestone.plans import contrastive as C
from lodestone.plans import factory, requests
from lodestone.plans.scratch import new_path, put
from lodestone.sources import corpora, footers, schemas, sinks, sqlite
from lodestone.sources.registry import resolve
from lodestone.streaming.windows import event_windows, sessions

# -- sources


@query("SELECT count(*)::BIGINT AS n, sum(r_regionkey)::BIGINT AS keys FROM region")
def s13_table_source(spark, d):
    load(spark, d, "region").createOrReplaceTempView("region_table")
    found = resolve({"type": "sql", "options": {"table_name": "region_table"}}).load(spark)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").cast("long").alias("keys"))


@query("SELECT n_nationkey, n_name FROM nation")
def s14_versioned_dataset(spark, d):
    root = new_path(spark, "datasets")
    load(spark, d, "nation").select("n_nationkey", "n_name").write.parquet(f"{root}/dataset=nations/version=1.0")
    return resolve({"type": "sql", "options": {"dataset_uri": "lake://dataset/nations/versions/1.0", "root": root}}).load(spark)


@query("SELECT least(7, count(*))::BIGINT AS n FROM orders")
def s17_row_limit(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders_table")
    return resolve({"type": "sql", "options": {"table_name": "orders_table", "limit": 7}}).load(spark).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def s24_json_lines(spark, d):
    path = new_path(spark, "json")
    load(spark, d, "nation").select("n_nationkey", "n_name").write.json(path)
    return resolve({"type": "files", "name": path, "options": {"format": "json"}}).load(spark)


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS input_ids, list(l_linenumber ORDER BY l_linenumber) AS labels FROM lineitem GROUP BY l_orderkey")
def s25_generated_tokens(spark, d):
    path = new_path(spark, "generated")
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.array(F.col("l_orderkey").cast("int")), F.sort_array(F.collect_list(F.col("l_linenumber").cast("int")))).alias("output"))
    for i in range(2):
        rows.filter(F.col("l_orderkey") % 2 == i).select("output").write.json(f"{path}/run{i}/deep")
    rest = lambda c: F.slice(c, 2, F.size(c) - 1)
    found = resolve({"type": "generated_tokens", "name": path}).load(spark)
    return found.select(F.col("input_ids")[0].cast("long").alias("l_orderkey"), rest("input_ids").alias("input_ids"), rest("labels").alias("labels"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def s26_folders(spark, d):
    path = new_path(spark, "folders")
    for i in range(3):
        load(spark, d, "customer").filter(F.col("c_custkey") % 3 == i).select("c_custkey", "c_mktsegment").write.parquet(f"{path}/part{i}")
    return resolve({"type": "folders", "name": path}).load(spark)


def _database(spark, d) -> str:
    """Regions and nations as a SQLite file in the shared folder, on whatever file system that is."""
    with tempfile.TemporaryDirectory() as folder:
        local = f"{folder}/world.sqlite"
        with closing(sqlite3.connect(local)) as c:
            c.execute("CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
            c.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER REFERENCES region (r_regionkey))")
            for table, names in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"])):
                rows = load(spark, d, table).select(*names).orderBy(names[0]).collect()
                c.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", [tuple(r) for r in rows])
            c.commit()
        path = f"{new_path(spark, 'sqlite')}/world.sqlite"
        put(spark, local, path)
    return path


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def s27_sqlite_scan(spark, d):
    return sqlite.scan(spark, _database(spark, d), "nation", 3)


@query("SELECT 'db' || n_regionkey AS db_id, 'which ' || n_name AS question, CASE WHEN n_nationkey % 2 = 0 THEN 'hint' END AS evidence, 'SELECT ' || n_nationkey AS \"SQL\" FROM nation")
def s29_sql_questions(spark, d):
    path = new_path(spark, "questions")
    rows = load(spark, d, "nation").select("n_nationkey", F.concat(F.lit("db"), F.col("n_regionkey").cast("string")).alias("db_id"), F.concat(F.lit("which "), "n_name").alias("question"), F.lit("hint").alias("evidence"), F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string")).alias("SQL"))
    even, odd = rows.filter("n_nationkey % 2 = 0").drop("n_nationkey"), rows.filter("n_nationkey % 2 = 1").drop("n_nationkey", "evidence").withColumnRenamed("SQL", "query")
    for name, part in (("a", even), ("b", odd)):  # one JSON list a file, as the corpora are published
        part.agg(F.to_json(F.collect_list(F.struct(*part.columns))).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    return corpora.sql_questions(spark, [f"{path}/a", f"{path}/b"])


@query("SELECT 'events' AS source, 'user: ' || p_name || ' assistant: ' || p_type AS chat FROM part")
def s31_prompt_rows(spark, d):
    rows = corpora.prompt_rows(load(spark, d, "part"), "p_name", "p_type", "events")
    return rows.select("source", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " ").alias("chat"))


@query("SELECT r_regionkey AS \"R_REGIONKEY\", r_name AS \"R_NAME\" FROM region")
def p9_s32_upper_names(spark, d):
    path = new_path(spark, "bootstrap")
    R.upper_names(load(spark, d, "region").select("r_regionkey", "r_name")).write.parquet(f"{path}/dataset=REGIONS/version=v1")
    return resolve({"type": "sql", "options": {"dataset_uri": "lake://dataset/REGIONS/versions/v1", "root": path}}).load(spark)


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT count(*)::BIGINT AS pairs, sum(n - 1)::BIGINT AS prompt_messages, md5(string_agg(text, '|' ORDER BY conv_id)) AS chosen FROM m WHERE i = n""")
def s11_preference_source(spark, d):
    path = new_path(spark, "preferences")
    chats = M.gather(load(spark, d, "conversations")).filter(F.size("messages") > 0)
    n = F.size("messages")
    worse = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == n - 1, F.concat(m["content"], F.lit(" no"))).otherwise(m["content"]).alias("content")))
    chats.select(F.col("messages").alias("chosen"), worse.alias("rejected"), "conv_id").coalesce(1).write.parquet(path)
    found = resolve({"type": "preference", "name": path}).load(spark)
    mine = chats.select("conv_id", F.slice("messages", 1, n - 1).alias("prompt"), F.element_at("messages", -1)["content"].alias("said"))
    one = found.join(mine, "prompt").filter(F.col("chosen")[0]["content"].eqNullSafe(F.col("said"))).dropDuplicates(["conv_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "said"))), lambda x: x["said"])
    return one.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.size("prompt")).alias("prompt_messages"), F.md5(F.array_join(listed, "|")).alias("chosen"))


# -- text and numbers


@query("SELECT p_partkey, p_name || '& fi' AS text FROM part")
def x13_normalised(spark, d):
    return load(spark, d, "part").select("p_partkey", X.normalised(F.concat("p_name", F.lit("&amp; \ufb01"))).alias("text"))


@query("SELECT p_partkey, (p_partkey * 1024)::DOUBLE AS binary, -p_size::DOUBLE * p_size AS power, p_size / 100.0::DOUBLE AS share FROM part")
def x17_human_numbers(spark, d):
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return load(spark, d, "part").select("p_partkey", X.human_numbers(F.concat(n, F.lit("Ki"))).alias("binary"), X.human_numbers(F.concat(F.lit("-"), size, F.lit("^2"))).alias("power"), X.human_numbers(F.concat(size, F.lit("%"))).alias("share"))



def _scaled(step: int, marks: list[str]) -> str:
    """A count of ``n`` in the first of its scales that holds it."""
    cases = []
    for i, mark in enumerate(["", *marks]):
        v = f"(n / {step**i}::DOUBLE)"
        text = f"CASE WHEN {v} >= 1000 THEN floor({v} / 1000)::BIGINT || '_' || lpad(printf('%.2f', {v} % 1000), 6, '0') ELSE printf('%.2f', {v}) END || '{mark}'"
        cases.append(f"WHEN n < {step ** (i + 1)} THEN {text}")
    return f"CASE WHEN n = 0 THEN '0' {' '.join(cases)} END"


@query(f"""SELECT o_orderkey, {_scaled(1000, ['K', 'M', 'B'])} AS human, {_scaled(1024, ['Ki', 'Mi', 'Gi'])} AS bytes,
CASE WHEN s < 60 THEN printf('%.3fs', s) ELSE CASE WHEN s >= 172800 THEN floor(s / 86400)::BIGINT || ' days, ' WHEN s >= 86400 THEN '1 day, ' ELSE '' END || floor(s % 86400 / 3600)::BIGINT || ':' || lpad(floor(s % 3600 / 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad(floor(s % 60)::BIGINT::VARCHAR, 2, '0') END AS spent
FROM (SELECT o_orderkey, o_orderkey * 97 AS n, (o_orderkey * 97) / 8.0::DOUBLE AS s FROM orders)""")
def x18_human_counts(spark, d):
    n = F.col("o_orderkey") * 97
    return load(spark, d, "orders").select("o_orderkey", X.human_count(n).alias("human"), X.human_count(n, binary=True).alias("bytes"), X.human_seconds(n / 8).alias("spent"))


# -- training data

_TOK = r"""chat AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
piece AS (SELECT conv_id, t, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT conv_id, t, regexp_extract_all(t, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])') AS p FROM chat)),
tok AS (SELECT conv_id, i, regexp_replace(p[i], '^\s*', '') AS w, sum(length(p[i])) OVER (PARTITION BY conv_id ORDER BY i) AS z FROM piece),
said AS (SELECT c.conv_id, strpos(t, text) - 1 AS a, strpos(t, text) - 1 + length(text) AS b FROM conversations c JOIN chat USING (conv_id) WHERE role = 'assistant'),
ins AS (SELECT tok.conv_id, i, w, bool_or(coalesce(z - length(w) >= a AND z <= b, false)) AS inside FROM tok LEFT JOIN said USING (conv_id) GROUP BY ALL),
lab AS (SELECT conv_id, i, ('0x' || substr(md5(w), 1, 6))::BIGINT % 65536 AS id, inside OR coalesce(lag(inside) OVER (PARTITION BY conv_id ORDER BY i), false) AS shown FROM ins),
seq AS (SELECT conv_id, count(*)::BIGINT AS n, string_agg(id, ',' ORDER BY i) AS ids, string_agg(CASE WHEN shown THEN id ELSE -100 END, ',' ORDER BY i) AS labels FROM lab GROUP BY conv_id)"""


def _chats(spark, d):
    chats = M.gather(load(spark, d, "conversations"))
    return chats.select(F.col("conv_id").alias("pos"), "messages")


def _digest(ids):
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


@query(f"""WITH {_TOK} SELECT conv_id AS pos, n::INT AS n, md5(ids || repeat(',0', ((-n) % 8 + 8)::INT % 8)) AS ids, md5(labels || repeat(',-100', ((-n) % 8 + 8)::INT % 8)) AS labels FROM seq WHERE n <= 300""")
def c1_sft(spark, d):
    out = factory.sft(_chats(spark, d), 300, HashTokenizer(), pad_to=8)
    return out.select("pos", F.col("lengths")[0].alias("n"), _digest(F.col("input_ids")).alias("ids"), _digest(F.col("labels")).alias("labels"))


@query(f"""WITH RECURSIVE {_TOK},
o AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42|{{"__id":' || conv_id || '}}'), 1, 15))::BIGINT) - 1 AS pos FROM seq WHERE n <= 300),
f AS (SELECT pos // 50 AS chunk, pos, 0 AS pack, n AS used FROM o WHERE pos % 50 = 0
  UNION ALL SELECT o.pos // 50, o.pos, f.pack + (f.used > 300 OR f.used + o.n > 300)::INT, CASE WHEN f.used > 300 OR f.used + o.n > 300 THEN o.n ELSE f.used + o.n END FROM f JOIN o ON o.pos = f.pos + 1 AND o.pos // 50 = f.chunk)
SELECT chunk::BIGINT AS chunk, pack::INT AS pack, count(*)::INT AS samples, sum(n)::BIGINT AS n, md5(string_agg(ids, ',' ORDER BY pos)) AS ids, md5(string_agg(labels, ',' ORDER BY pos)) AS labels FROM f JOIN o USING (pos) GROUP BY ALL""")
def c1_sft_packed(spark, d):
    out = factory.sft(_chats(spark, d), 300, HashTokenizer(), pack=True, chunk=50)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("chunk", "pack", F.size("lengths").alias("samples"), total.alias("n"), _digest(F.col("input_ids")).alias("ids"), _digest(F.col("labels")).alias("labels"))


@query(r"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents),
i AS (SELECT pos, list_concat([1], list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 6))::BIGINT % 65536), [2]) AS ids FROM p),
r AS (SELECT pos // 50 AS chunk, pos, ids, len(ids) AS n, len(ids) // 128 AS k, len(ids) % 128 AS tail FROM i),
a AS (SELECT chunk, pos, ids[x * 128 + 1:x * 128 + 128] AS part, 'full' AS kind, x AS pack FROM (SELECT *, unnest(range(k)) AS x FROM r)),
e AS (SELECT chunk, unnest(ids[k * 128 + 1:]) AS id, pos, unnest(range(tail)) AS j FROM r WHERE tail > 0),
s AS (SELECT chunk, id, row_number() OVER (PARTITION BY chunk ORDER BY pos, j) - 1 AS place FROM e),
t AS (SELECT chunk, place // 128 AS pack, list(id ORDER BY place) AS part FROM s GROUP BY ALL)
SELECT chunk::BIGINT AS chunk, kind, pack::BIGINT AS pack, md5(array_to_string(part, ',')) AS ids FROM a UNION ALL SELECT chunk, 'tail', pack, md5(array_to_string(part, ',')) FROM t WHERE len(part) = 128""")
def c2_causal(spark, d):
    docs = position.with_position(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return factory.causal(docs, 128, 50).select("chunk", "kind", "pack", _digest(F.col("input_ids")).alias("ids"))


_ANSWERED = "SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"


def _ids_of(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda x: ('0x' || substr(md5(x), 1, 6))::BIGINT % 65536)"


_SAY = "'<|im_start|>{r}' || chr(10) || {t} || '<|im_end|>' || chr(10)"


@query(f"""WITH p AS ({_ANSWERED}),
i AS (SELECT conv_id, turn, list_prepend(1, {_ids_of(_SAY.format(r='user', t='q'))}) AS p, list_append({_ids_of(_SAY.format(r='assistant', t='a'))}, 2) AS c, list_append({_ids_of(_SAY.format(r='assistant', t="'no idea'"))}, 2) AS r FROM p)
SELECT conv_id, turn, md5(array_to_string(list_concat(p, c), ',')) AS chosen, md5(array_to_string(list_concat(p, r), ',')) AS rejected, md5(array_to_string(list_concat(list_transform(p, lambda x: -100), c), ',')) AS labels FROM i""")
def c3_preference(spark, d):
    turns = load(spark, d, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    pairs = asked.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", one("user", F.col("q")).alias("prompt"), one("assistant", F.col("a")).alias("chosen"), one("assistant", F.lit("no idea")).alias("rejected"))
    out = factory.preference(pairs, 1_000_000, 1_000_000)
    return out.select("conv_id", "turn", _digest(F.col("chosen_input_ids")).alias("chosen"), _digest(F.col("rejected_input_ids")).alias("rejected"), _digest(F.col("chosen_labels")).alias("labels"))


@query("""WITH b AS (SELECT o_orderkey // 64 AS batch_id, o_orderkey, count(*) AS n, sum(l_linenumber) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT batch_id, count(*)::INT AS queries, least(max(n), 5)::INT AS longest, sum(least(n, 5))::BIGINT AS tokens FROM b GROUP BY batch_id)
SELECT q.batch_id::BIGINT AS batch_id, queries, longest, tokens, p.pairs::INT AS pairs FROM q JOIN (SELECT o_orderkey // 64 AS batch_id, count(DISTINCT o_orderkey || '|' || l_suppkey) AS pairs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) p USING (batch_id)""")
def c4_r7_contrastive_batches(spark, d):
    lines = load(spark, d, "orders").select("o_orderkey").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("batch_id", F.floor(F.col("o_orderkey") / 64))
    ids = lambda c: F.sort_array(F.collect_list(c))
    tables = {
        "queries": lines.groupBy("batch_id", F.col("o_orderkey").alias("query_id")).agg(ids("l_linenumber").alias("input_ids")),
        "documents": lines.select("batch_id", F.col("l_suppkey").alias("document_id"), F.array(F.col("l_suppkey").cast("int")).alias("input_ids")).distinct(),
        "relations": lines.select("batch_id", F.col("o_orderkey").alias("query_id"), F.col("l_suppkey").alias("document_id"), F.lit(1).alias("relevance")),
    }
    path = new_path(spark, "contrastive")
    sinks.write_batches(tables, path, {"size": 64})
    out = C.contrastive(spark, path, [("again", path)], 5)["again"]
    tokens = F.aggregate(F.flatten("query_id_mask"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("batch_id", F.size("query_ids").alias("queries"), F.col("query_id_length").alias("longest"), tokens.alias("tokens"), F.size("relevance").alias("pairs"))


@query("""SELECT p_partkey, list_transform(range(p_size + 2), lambda x: CASE WHEN ('0x' || substr(md5('42|' || p_partkey), 1, 15))::BIGINT / (1::BIGINT << 60)::DOUBLE < 0.5 OR x < p_size THEN x ELSE x - p_size END) AS positions FROM part""")
def w5_fused_positions(spark, d):
    ids = packing.position_ids(F.array(F.col("p_size").cast("long"), F.lit(2).cast("long")))
    return load(spark, d, "part").select("p_partkey", packing.fused_positions(ids, F.col("p_partkey"), 0.5).cast("array<bigint>").alias("positions"))


@query("SELECT vec_id AS token, (label % 16)::INT AS expert, ((label % 16) // 4)::INT AS rank, row_number() OVER (PARTITION BY (label % 16) // 4 ORDER BY label % 16, vec_id) - 1 AS slot FROM embeddings")
def n9_exchange(spark, d):
    tokens = load(spark, d, "embeddings").select(F.col("vec_id").alias("token"), (F.col("label") % 16).cast("int").alias("expert"))
    return R.exchange(tokens, "expert", 4, "token")


# -- schemas, prompts, requests

_WORLD = [("region", ["r_regionkey", "r_name"], {}), ("nation", ["n_nationkey", "n_name", "n_regionkey"], {"n_regionkey": ("region", "r_regionkey")})]


def _first_values(table: str, column: str, n: int, mark: str) -> str:
    """The first distinct values of a column in the order of the table's key, as one text."""
    distinct = f"SELECT {column}::VARCHAR AS v, min({table[0]}_{table}key) AS o FROM {table} WHERE {column}::VARCHAR <> '' GROUP BY v"
    return f"(SELECT string_agg('{mark}' || v || '{mark}', ', ' ORDER BY o) FROM (SELECT v, row_number() OVER (ORDER BY o) AS o FROM ({distinct})) WHERE o <= {n})"


def _plain_sql() -> str:
    tables = []
    for table, names, refs in _WORLD:
        lines = [f"'{table} :'"]
        for i, c in enumerate(names):
            kind = "TEXT" if c.endswith("name") else "INTEGER"
            tail = "primary_key" if i == 0 else f" {table}.{c}={refs[c][0]}.{refs[c][1]}" if c in refs else ""
            lines.append(f"rtrim('{c} [ {kind} ] ( ' || {_first_values(table, c, 3, chr(34))} || ' ) {tail}')")
        tables.append(" || chr(10) || ".join(lines))
    return "SELECT 'world' AS db_id, " + " || chr(10) || chr(10) || ".join(tables) + " AS schema_text"


@query(_plain_sql())
def q1_plain_schema(spark, d):
    return schemas.plain_schema(_distinct_catalog(spark, d))


def _distinct_catalog(spark, d):
    return schemas.catalog_of(spark, {"world": _database(spark, d)})


def _ddl_sql() -> str:
    tables = []
    for table, names, refs in _WORLD:
        lines = []
        for c in names:
            kind = "TEXT" if c.endswith("name") else "INTEGER"
            lines.append(f"'    {c} {kind}, -- example: [' || {_first_values(table, c, 6, chr(39) * 2)} || ']'")
        lines.append(f"'    PRIMARY KEY ({names[0]})" + (",'" if refs else "'"))
        for c, (other, target) in refs.items():
            lines.append(f"'    CONSTRAINT fk_{table}_{c} FOREIGN KEY ({c}) REFERENCES {other} ({target})'")
        tables.append(f"'CREATE TABLE {table} (' || chr(10) || " + " || chr(10) || ".join(lines) + " || chr(10) || ');'")
    return "SELECT 'world' AS db_id, " + " || chr(10) || chr(10) || ".join(tables) + " AS schema_text"


@query(_ddl_sql())
def q2_ddl_schema(spark, d):
    return schemas.ddl_schema(_distinct_catalog(spark, d), X.sql_words(spark))


@query("""WITH c AS (SELECT unnest([0, 1, 2, 3, 4]) AS column_pos, unnest(['r_regionkey', 'r_name', 'n_nationkey', 'n_name', 'n_regionkey']) AS name),
m AS (SELECT n_nationkey AS sample_id, column_pos, column_pos IN (0, 2, 4) OR contains('select ' || lower(CASE WHEN n_nationkey % 2 = 0 THEN 'n_name' ELSE '1' END), name) AS needed FROM nation, c),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY needed, ('0x' || substr(md5('42|' || sample_id || '|' || column_pos), 1, 15))::BIGINT) AS r, sum(needed::INT) OVER (PARTITION BY sample_id) AS k FROM m)
SELECT sample_id, 'world' AS db_id, column_pos FROM r WHERE needed OR r <= floor((floor(('0x' || substr(md5('43|' || sample_id), 1, 15))::BIGINT / (1::BIGINT << 60)::DOUBLE * 10) + 1) * (5 - k) / 10)""")
def q3_training_columns(spark, d):
    used = load(spark, d, "nation").select(F.col("n_nationkey").alias("sample_id"), F.lit("world").alias("db_id"), F.concat(F.lit("SELECT "), F.when(F.col("n_nationkey") % 2 == 0, "n_name").otherwise("1")).alias("answer"))
    return schemas.training_columns(_distinct_catalog(spark, d), used)


@query("SELECT n_nationkey, md5('Database schema:' || chr(10) || r_name || chr(10) || chr(10) || 'Question:' || chr(10) || n_name || chr(10) || chr(10) || 'This query failed:' || chr(10) || '```sql' || chr(10) || 'SELECT ' || n_nationkey || chr(10) || '```' || chr(10) || 'Error: ' || chr(10) || chr(10) || 'Give a corrected query in a ```sql block.') AS digest FROM nation JOIN region ON r_regionkey = n_regionkey")
def x9_prompts(spark, d):
    both = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = prompts.filled("sql_repair", schema=F.col("r_name"), question=F.col("n_name"), sql=F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string")), error=F.lit(None))
    return both.select("n_nationkey", F.md5(text).alias("digest"))


def _asked(spark, d):
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    turns = load(spark, d, "conversations").withColumn("key", F.col("conv_id") * 10_000 + F.col("turn"))
    return requests.requests(turns, "key", message, "none", "chat", temperature=0.5)


def _echo():
    """A backend without a model: it says what it was asked, with a mark, and fails on texts that hold a question mark."""

    def answer(request: dict) -> dict:
        said = request["body"]["messages"][-1]["content"]
        if "?" in said:
            raise ValueError("asked back")
        return {"body": {"choices": [{"message": {"role": "assistant", "content": said + "!"}}, {"message": {"role": "assistant", "content": request["custom_id"]}}]}}

    return answer


@query("""WITH p AS (SELECT text, row_number() OVER (ORDER BY conv_id * 10000 + turn) - 1 AS pos FROM conversations)
SELECT (pos % 100)::INT AS item, count(*)::BIGINT * 2 AS contents, md5(string_agg(text || '!|chat_' || pos, '|' ORDER BY 'chat_' || pos)) AS digest FROM p WHERE NOT contains(text, '?') GROUP BY 1""")
def y1_y4_y6_answers_by_item(spark, d):
    answered = requests.answered(_asked(spark, d), _echo)
    item = (X.custom_id_number(F.col("custom_id")) % 100).cast("int")
    found = requests.by_item(requests.extracted(answered, "chat"), item)
    return found.select("item", F.size("contents").cast("long").alias("contents"), F.md5(F.array_join("contents", "|")).alias("digest"))


@query("WITH p AS (SELECT text, row_number() OVER (ORDER BY conv_id * 10000 + turn) - 1 AS pos FROM conversations) SELECT 'chat_' || pos AS custom_id, md5(text || '!') AS digest FROM p WHERE NOT contains(text, '?')")
def y3_remote_batch(spark, d):
    batch = requests.RemoteBatch(spark, new_path(spark, "remote"), per_file=200)
    batch.add(_asked(spark, d).filter(~F.col("request").contains("?")))
    service = requests.OfflineTransport(_echo(), delay=1, folder=new_path(spark, "service"))
    while not batch.step(service):
        pass
    return requests.extracted(batch.responses(), "chat").select("custom_id", F.md5(F.col("choices")[0]["content"]).alias("digest"))


@query("SELECT count(*)::BIGINT AS n FROM nation")
def k13_report(spark, d):
    path = new_path(spark, "report")
    sinks.write_report(spark, path, {"naïve": [r[0] for r in load(spark, d, "nation").select("n_name").collect()]})
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    return spark.createDataFrame([(len(json.loads(text)["naïve"]),)], "n long")


# -- windows, audits, gathers and embeddings


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (6 * i) HOUR AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 4)) AS i) GROUP BY ALL""")
def v1_sliding_windows(spark, d):
    rows = event_windows(load(spark, d, "events"), "24 hours", step="6 hours")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def v1_session_windows(spark, d):
    rows = sessions(load(spark, d, "events"), "user_id", "12 hours")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


_AUDITED = ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS footer_rows, count(*)::BIGINT AS read_rows, 0::BIGINT AS problems FROM {t}" for t in _AUDITED))
def s18_footer_audit(spark, d):
    found = footers.audit(spark, *[f"{d}/{t}.parquet" for t in _AUDITED])
    name = F.regexp_extract("path", r"/(\w+)\.parquet(?:/[^/]*)?$", 1)
    return found.groupBy(name.alias("table_name")).agg(F.sum("footer_rows").alias("footer_rows"), F.sum("read_rows").alias("read_rows"), F.count("problem").alias("problems"))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
i AS (SELECT o_orderkey AS place, (o_orderkey * 7919) % (SELECT count(*) + 10 FROM documents) AS index FROM orders)
SELECT place, doc_id FROM i LEFT JOIN p ON pos = index""")
def p6_gather(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    asked = load(spark, d, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_orderkey") * 7919 % (docs.count() + 10)).alias("index"))
    return position.gather(position.with_position(docs, "doc_id"), asked, "null")


@query("""WITH w AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 16 AS place FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''),
c AS (SELECT doc_id, (place // 2)::INT AS i, sum(1 - 2 * (place % 2)) AS x FROM w GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)::DOUBLE) AS size FROM c GROUP BY doc_id)
SELECT d.doc_id, d.i::INT AS i, round(coalesce(x / CASE WHEN size > 0 THEN size ELSE 1 END, 0), 6) AS x FROM (SELECT doc_id, unnest(range(0, 8)) AS i FROM documents WHERE text IS NOT NULL) d LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = d.i LEFT JOIN n ON n.doc_id = d.doc_id""")
def r1_embed(spark, d):
    made = embedding.embed(load(spark, d, "documents").select("doc_id", "text"), embedding.HashedEmbedder(8))
    return made.select("doc_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(r"""WITH t AS (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) + 2 AS n FROM documents)
SELECT 'combined' AS stage, count(*)::BIGINT AS n_rows, NULL::BIGINT AS tokens FROM t UNION ALL SELECT 'tokenised', count(n)::BIGINT, sum(n)::BIGINT FROM t""")
def v15_stage_counts(spark, d):
    stages = Stages()
    factory.build(spark, {"type": "causal", "sources": [f"{d}/documents.parquet"], "options": {"max_length": 128}}, stages)
    rows = [(name, seen["rows"], seen.get("tokens")) for name, seen in stages.report().items()]
    return spark.createDataFrame(rows, "stage string, n_rows long, tokens long")


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS t FROM nation)
SELECT 'r' || n_regionkey AS db_id, string_agg(n_name || ' :' || chr(10) || 'id [ NUMBER ] (  ) primary_key' || chr(10) || 'up [ TEXT ] (  )' || CASE WHEN t > 0 THEN '  ' || n_name || '.up=' || first || '.id' ELSE '' END, chr(10) || chr(10) ORDER BY t) AS schema_text
FROM n JOIN (SELECT n_regionkey, n_name AS first FROM n WHERE t = 0) USING (n_regionkey) GROUP BY n_regionkey""")
def s29_metadata_schema(spark, d):
    """A database a region and a table a nation, whose ``up`` refers to the first table; its metadata as published, with keys as numbers and as lists."""
    path = new_path(spark, "metadata")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    by = load(spark, d, "nation").groupBy("n_regionkey").agg(names.alias("table_names_original")).withColumn("n", F.size("table_names_original"))
    numbers = F.sequence(F.lit(0), F.col("n") - 1)
    pair = lambda i, name: F.array(i.cast("string"), F.lit(name))
    columns = F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), F.flatten(F.transform(numbers, lambda i: F.array(pair(i, "id"), pair(i, "up")))))
    kinds = F.concat(F.array(F.lit("text")), F.flatten(F.transform(numbers, lambda i: F.array(F.lit("number"), F.lit("text")))))
    firsts = F.transform(numbers, lambda i: 2 * i + 1)
    keys = F.when(F.col("n_regionkey") % 2 == 0, F.to_json(firsts)).otherwise(F.to_json(F.array(firsts)))
    links = F.transform(F.filter(numbers, lambda i: i > 0), lambda i: F.array(2 * i + 2, F.lit(1)))
    row = F.to_json(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("db_id"), "table_names_original", columns.alias("column_names_original"), columns.alias("column_names"), kinds.alias("column_types"), links.alias("foreign_keys")))
    whole = F.concat(F.regexp_replace(row, r"\}$", ', "primary_keys": '), keys, F.lit("}"))
    by.agg(F.concat(F.lit("["), F.array_join(F.collect_list(whole), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return schemas.plain_schema(schemas.metadata_catalog(spark, path))
