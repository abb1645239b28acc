"""The thin queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, mixing, near_dedup, packing, pii, tokens, toxicity, url_filter, warc
from .common import cut, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op2_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op3_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"), words_per_shingle=5)


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no time of capture, so a time of its own is made of each page's id."""
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    seconds = F.lit(1_577_836_800) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))
    pages = table(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(seconds))
    try:
        index = cut(warc.captured(pages, path, least_bytes=0, time_col="captured"))
    finally:
        warc.remove(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "place")


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"), keep="largest")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"), limit=2048)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).drop("source", "text_hash")


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2, percent=80).drop("text_hash")


def op10_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(kind, F.col("base")).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


OP2_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut_off AS (
  SELECT page_id, split_part(split_part(rest, '?', 1), '#', 1) AS rest FROM rests
), split AS (
  SELECT page_id,
         translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut_off
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS r
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE r = 1) f ON split.page_id = f.page_id
"""

OP4_SQL = """
WITH rests AS (
  SELECT page_id, html, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, split_part(split_part(rest, '?', 1), '#', 1) AS address, CASE WHEN strpos(rest, '?') > 0 THEN split_part(substr(rest, strpos(rest, '?')), '#', 1) ELSE '' END AS query FROM rests
), hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
         array_to_string(list_reverse(string_split(translate(split_part(address, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',') || ')'
           || lower(CASE WHEN strpos(address, '/') > 0 THEN substr(address, strpos(address, '/')) ELSE '' END) || lower(query) AS url_key,
         strftime(make_timestamp((1577836800 + page_id * 7919 % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS captured_at
  FROM split
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS largest, row_number() OVER (ORDER BY encode(url_key), captured_at) - 1 AS place FROM hashed
)
SELECT page_id, payload_bytes,
       translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8)
                 || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to,
       url_key, captured_at, place
FROM grouped
"""

OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

# Water filling: sources by cap over weight; the capped ones come first, the others share what is left.
OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), rows AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substring(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
         strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS solid
  FROM docs
), keyed AS (
  SELECT *, -ln(u) / (CASE WHEN solid = 0 THEN 0.01::DOUBLE ELSE greatest(0.01::DOUBLE, letters::DOUBLE / solid::DOUBLE) END) AS k FROM rows
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM sources
), sums AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER up_to, 0))::BIGINT AS remaining, (sum(w) OVER onward)::BIGINT AS shares
  FROM weighed
  WINDOW up_to AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), first_open AS (
  SELECT remaining, shares FROM sums WHERE cap * shares > w * remaining ORDER BY cap / w, encode(source) NULLS LAST LIMIT 1
), aims AS (
  SELECT source, source_size,
         CASE WHEN cap * shares <= w * remaining THEN cap::DOUBLE
              ELSE (w * (SELECT remaining FROM first_open))::DOUBLE / (SELECT shares FROM first_open)::DOUBLE END AS target
  FROM sums
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aims
), placed AS (
  SELECT keyed.doc_id, keyed.size, e.source_size, e.target, e.epochs,
         sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed JOIN epochs e ON keyed.source IS NOT DISTINCT FROM e.source
), chosen AS (
  SELECT *, epochs + CASE WHEN epochs < 3 AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM chosen
"""

# All pairs that share a shingle, then reachability; for tables of some thousand documents.
OP9_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    named = {name.split("_")[0]: name for name in queries()}
    return {named[key[:-4].lower()]: sql for key, sql in globals().items() if key.endswith("_SQL") and key[:-4].lower() in named}
