"""The thin ``opN_*`` queries: each applies its operator, with production
parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from . import decontaminate, language_id, packing, rp_forest, sharding, simhash, sql, token_counts, token_files, url_filter, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_table(spark, sf_dir, "documents"), WORD_BPE))


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op3_pack_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.truncations(token_counts.store(_table(spark, sf_dir, "documents"), WORD_BPE), 2048)


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the synthetic pages: their hosts, the domains above and the first
    path segments, some of them listed, delisted and listed again on days that
    follow from a hash of the key."""
    keys = pages.select(F.explode(url_filter.keys_of(F.col("url"), segments=1)).alias("key")).where(r"key rlike '^d:.*[.]|^u:[^/]*/[^/]*$'").distinct()
    number = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("int")
    dealt = keys.withColumn("h", number).where("h % 3 = 0 or key rlike '[.-](ads|track)'")
    added = F.date_add(F.lit("2024-01-01").cast("date"), F.col("h") % 200)
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add(added, days).alias("day"))
    dates = F.array(event("add", 0), F.when(F.col("h") % 5 != 0, event("remove", 60)), F.when(F.col("h") % 5 == 1, event("add", 120)))
    return dealt.select("key", F.explode(F.filter(dates, lambda d: d.isNotNull())).alias("e")).select("key", "e.action", "e.day")


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return url_filter.filter_urls(pages.withColumn("fetched_on", fetched), dated_list(pages))


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.+$', '')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
keyed AS (
  SELECT page_id, url, fetched_on, unnest(list_distinct(list_concat(
           CASE WHEN host LIKE '[%' THEN ['d:' || host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.')) END,
           list_transform(range(1, len(segs) + 1), lambda i: 'u:' || host || '/' || array_to_string(segs[1:i], '/'))))) AS key
  FROM parts WHERE host <> ''),
dealt AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT key FROM keyed)
  WHERE regexp_matches(key, '^d:.*[.]|^u:[^/]*/[^/]*$')),
spans AS (
  SELECT key, DATE '2024-01-01' + h % 200 AS since, CASE WHEN h % 5 <> 0 THEN DATE '2024-01-01' + h % 200 + 60 ELSE DATE '9999-01-01' END AS until
  FROM dealt WHERE h % 3 = 0 OR regexp_matches(key, '[.-](ads|track)')
  UNION ALL
  SELECT key, DATE '2024-01-01' + h % 200 + 120, DATE '9999-01-01' FROM dealt WHERE h % 5 = 1 AND (h % 3 = 0 OR regexp_matches(key, '[.-](ads|track)'))),
best AS (
  SELECT page_id, url, fetched_on, count(*) AS n_active, arg_max(key, (length(key), key)) AS matched, arg_max(since, (length(key), key)) AS listed_since
  FROM keyed JOIN spans USING (key) WHERE since <= fetched_on AND fetched_on < until GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched_on, coalesce(n_active, 0) AS n_active, matched, listed_since, n_active IS NOT NULL AS blocked
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url
"""


def op8_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(_table(spark, sf_dir, "embeddings"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _nibble(n: int) -> int:
    """CRC-32 of four bits: the table of sixteen follows from the polynomial."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_TABLE = f"[{', '.join(str(_nibble(n)) for n in range(16))}]"
_BYTE = "xor(c, b)"
for _half in range(2):
    _BYTE = f"xor(({_BYTE}) >> 4, {_TABLE}[(({_BYTE}) & 15) + 1])"
OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: {_BYTE}, CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM documents),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS row, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT *, CAST(least(15, ((upto * 2 - size) * 16) // (total * 2)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""

OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE text IS NOT NULL AND item_id IS NOT NULL),
patterns AS (SELECT DISTINCT item_id, m, w[s : s + m - 1] AS p FROM (SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
windows AS (SELECT doc_id, m, s, w[s : s + m - 1] AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs CROSS JOIN (SELECT DISTINCT m FROM patterns))),
hits AS (SELECT DISTINCT doc_id, s, m, item_id FROM windows JOIN patterns USING (m, p)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP10_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
known AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM sized)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(top, page_id) AS refers_to FROM known
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_shard_by_bytes, op3_pack_ordered, op4_gray_simhash, op5_wu_manber_decontamination, op6_prefix_token_counts,
        op7_temporal_url_filter, op8_kneser_ney_language, op9_rp_forest, op10_warc_salvage,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_shard_by_bytes": OP2_SQL, "op4_gray_simhash": sql.simhash_components(), "op5_wu_manber_decontamination": OP5_SQL, "op7_temporal_url_filter": OP7_SQL, "op10_warc_salvage": OP10_SQL}
