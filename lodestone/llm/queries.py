"""The contract queries of this subpackage and their SQL.

Every query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, licenses, line_dedup, mixing, near_dedup, quality, ranked_search, rules, sharding, spelling, url_filter, warc
from lodestone.plans.scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, held: int):
    """Whether a row is held out, by its doc_id; false for a null one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    learnt = langid.learn(docs, allowed)
    rows = docs.select("doc_id", "text", _fold(4, 2).alias("held_out"))
    return langid.identify(rows, learnt, ("doc_id", "held_out"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = _table(spark, sf_dir, "documents")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = quality.train(docs, _table(spark, sf_dir, "labels"), allowed)
    rows = docs.select("doc_id", "text", _fold(3, 1).alias("held_out"))
    return quality.score(rows, model, ("doc_id", "held_out"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words that the mix takes of each."""
    return mixing.Mix(_table(spark, sf_dir, "documents")).taken()


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their measurements, failure bits and verdicts, and the versions of the policy that keep them, from the stored ledger."""
    verdicts = rules.apply_policy(rules.store_ledger(_table(spark, sf_dir, "documents")))
    kept_by = rules.kept_by(F.col("failures")).alias("kept_by")
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", kept_by)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a license notice."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose later copies of repeated line runs, with the documents that keep the first."""
    gone = line_dedup.removals(_table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "first_doc_ids", F.size("removed").cast("long").alias("removed_lines"), "removed_words", "removed", "runs")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near copies that each belongs to."""
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_table(warc.read_warc(spark, path))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"))


#: Rules of host, path and action; fixed by the query's contract.
URL_RULES = "SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, action)"
#: A run in so many loses a letter; fixed by the query's contract.
DAMAGE = 199


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling.variants(spelling.count_words(_table(spark, sf_dir, "documents"), damage=DAMAGE))


QUERIES = {f.__name__: f for f in (op1_langid, op2_quality, op3_mixing, op4_sharding, op5_quality_rules, op6_decontamination, op7_license_scan, op8_line_dedup, op9_near_dedup, op10_warc, op11_ranked_search, op12_url_filter, op13_spelling)}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3)::INT] AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k, 2.0::DOUBLE * source_size AS cap FROM s1),
lev AS (
  SELECT k, (1.5::DOUBLE * (SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / w AS ratio
  FROM s2),
lam AS (SELECT level FROM lev WHERE level <= ratio ORDER BY k LIMIT 1),
goal AS (SELECT source, source_size, least(cap, (SELECT level FROM lam) * w)::DOUBLE AS target FROM s2),
goal2 AS (SELECT *, floor(target)::BIGINT AS tokens FROM goal),
p AS (
  SELECT d.*, g.source_size, g.target, g.tokens,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN goal2 g ON d.source IS NOT DISTINCT FROM g.source),
live AS (
  SELECT source, tokens, row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) AS k,
         sum(tokens) OVER (ORDER BY source IS NULL, encode(coalesce(source, '')))::HUGEINT * 18446744073709551616 // (SELECT sum(tokens) FROM goal2)::HUGEINT AS edge
  FROM goal2 WHERE tokens > 0),
n AS (SELECT ceil((SELECT sum(tokens) FROM goal2) / 512.0)::BIGINT AS slots),
pts AS (
  SELECT i AS slot, 1 + (SELECT count(*) FROM live WHERE edge <= (i::HUGEINT * 11400714819323198485) % 18446744073709551616) AS k
  FROM (SELECT unnest(range((SELECT slots FROM n))) AS i)
  UNION ALL SELECT (SELECT slots FROM n) + k - 1, k FROM live),
rk AS (SELECT slot, k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY k) AS slots_of FROM pts),
per AS (SELECT DISTINCT k, slots_of, tokens // slots_of AS q, tokens % slots_of AS rem FROM rk JOIN live USING (k)),
b AS (
  SELECT p.*, live.k, CASE WHEN start < rem * (q + 1) THEN start // (q + 1) ELSE rem + (start - rem * (q + 1)) // greatest(q, 1) END AS rank
  FROM p LEFT JOIN live ON p.source IS NOT DISTINCT FROM live.source LEFT JOIN per USING (k))
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (b.tokens // source_size) * size + greatest(0, least(size, b.tokens % source_size - start)) END)::BIGINT AS taken,
       CASE WHEN size > 0 AND start < b.tokens THEN rk.slot END::BIGINT AS first_slot
FROM b LEFT JOIN rk ON b.k = rk.k AND b.rank = rk.rank
"""

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(ln.n_lines, 0)::BIGINT AS n_lines, coalesce(ln.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters
  FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
         + 32 * (n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (n_letters > 0 AND 100 * n_upper > 40 * n_letters)::BIGINT
         + 128 * (100 * n_letters < 50 * word_chars)::BIGINT + 256 * (n_lines > 5 AND n_words < 2 * n_lines)::BIGINT + 512 * (n_words > 1000000)::BIGINT AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 127 = 0 AS kept, failures,
       list_filter(['base', 'v1', 'v2', 'length_only'], lambda v: failures & CASE v WHEN 'base' THEN 3 WHEN 'v1' THEN 127 WHEN 'v2' THEN 511 ELSE 515 END = 0) AS kept_by FROM f
"""

_OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND (page_id < top OR page_id IS NULL AND top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND (page_id < top OR page_id IS NULL AND top IS NOT NULL) THEN top END AS refers_to
FROM m
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS N, coalesce(sum(len(ts)), 0)::BIGINT AS L FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS term FROM d) GROUP BY r, doc_id, len(ts), term),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT N FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
sc AS (
  SELECT item_id, r, doc_id, sum(c * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT N FROM s)) // (SELECT L FROM s)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, r, doc_id),
rk AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM rk WHERE rank <= 20
"""

_OP12 = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(u, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT r, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(a, length(rules.h || rules.p)) AS a FROM h JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM h LEFT JOIN f USING (r)
"""

ORACLE_SQL = {"op12_url_filter": _OP12, "op11_ranked_search": _OP11, "op10_warc": _OP10, "op3_mixing": _OP3, "op5_quality_rules": _OP5}
