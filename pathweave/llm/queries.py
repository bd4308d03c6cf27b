"""The registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import (
    bpe_codec, crf_quality, decontaminate, language_id, license_scan, ngram_join, prefix_trie, quality_rules, sharding, substring_dedup,
    token_alignment, token_counts, warc,
)
from pathweave.llm.common import read_table


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.repeated_runs(read_table(spark, d, "documents")).drop("sig")


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = token_counts.token_counts(read_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_bpe_codec(spark: SparkSession, d: str) -> DataFrame:
    return bpe_codec.encode_documents(read_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, d, "documents")).drop("host_rate")


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(read_table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.license_labels(read_table(spark, d, "documents"))


def op7_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, d, "documents"))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    shards = sharding.assign_shards(read_table(spark, d, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality_crf(spark: SparkSession, d: str) -> DataFrame:
    return crf_quality.quality_scores(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, d, "conversations"))


def op12_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.predict_languages(read_table(spark, d, "documents"))


def op13_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return token_alignment.align_tokens(read_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH split AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*{_WORDS}')) AS token,
         generate_subscripts(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*{_WORDS}'), 1) AS i
  FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT doc_id, i, regexp_extract(token, '{_WORDS}') AS word, contains(token, chr(10)) AS breaks,
         sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM split),
begun AS (
  SELECT *, CAST(i = 1 OR breaks OR regexp_matches(lag(word) OVER (PARTITION BY doc_id ORDER BY i), '[.!?]$') AS INTEGER) AS begins
  FROM placed),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS number FROM begun),
units AS (
  SELECT doc_id, number, min(stop - length(word)) AS start, max(stop) AS stop, count(*) AS n_words,
         string_agg({_LOWER.format('word')}, ' ' ORDER BY i) AS unit
  FROM numbered GROUP BY doc_id, number),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, number) AS rank,
         first_value(doc_id) OVER (PARTITION BY unit ORDER BY doc_id, number) AS first_doc_id
  FROM units),
later AS (
  SELECT *, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS island FROM ranked WHERE rank > 1)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, count(*) AS n_units,
       CAST(sum(n_words) AS BIGINT) AS n_words, arg_max(first_doc_id, n_words * 1000000000 - number) AS first_doc_id
FROM later GROUP BY doc_id, island HAVING sum(n_words) >= {substring_dedup.MIN_RUN_WORDS}"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
r AS (
  SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines AS rule_failed FROM b),
h AS (
  SELECT host, count(*) AS host_docs, CAST(sum(CAST(rule_failed AS BIGINT)) AS BIGINT) AS host_failures FROM r GROUP BY host),
f AS (
  SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(host_docs) AS DOUBLE) AS n, sum(CAST(host_docs AS DOUBLE) * host_docs) AS n2,
         sum(host_failures) / CAST(sum(host_docs) AS DOUBLE) AS m,
         sum(CAST(host_failures AS DOUBLE) * host_failures / host_docs) AS sq
  FROM h),
v AS (SELECT *, (sq - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - n2 / n, 0) AS var FROM f),
p AS (
  SELECT m, greatest(2.0, least(10000.0, CASE WHEN k > 1 AND var > 0 THEN m * (1 - m) / var - 1 ELSE 10000.0 END)) AS strength
  FROM v),
o AS (SELECT h.*, (host_failures + m * strength) / (host_docs + strength) <= 0.5 AS host_ok FROM h, p)
SELECT r.*, o.host_docs, o.host_failures, o.host_ok, NOT r.rule_failed AND o.host_ok AS kept
FROM r JOIN o ON r.host IS NOT DISTINCT FROM o.host"""

_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS g FROM items, unnest(range(1, len(w) - k + 2)) AS t(i)),
ks AS (SELECT DISTINCT k FROM items),
hits AS (
  SELECT DISTINCT doc_id, x.i, x.k, item_id
  FROM (SELECT doc_id, k, i, w[i:i + k - 1] AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)) x JOIN wins USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id),
partners AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, len(s.g) AS n_shingles, min(reach.r) AS component_id, coalesce(max(partners.n), 0) AS n_links
FROM s JOIN reach ON reach.doc_id = s.doc_id LEFT JOIN partners ON partners.a = s.doc_id GROUP BY s.doc_id, s.g"""


# The checksum of an id is the usual CRC-32, bit by bit over its decimal digits.
PREFIX_TRIE = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'id': id, 'words': len(regexp_extract_all(text, '{_WORDS}'))}} ORDER BY turn NULLS FIRST, id) AS s
  FROM t GROUP BY conv_id),
h AS (
  SELECT *, CAST(xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, b: list_reduce(
      list_concat([xor(a, b)], CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])),
      lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))),
    CAST(4294967295 AS BIGINT)) % 4 AS INTEGER) AS h
  FROM own),
rebuilt AS (
  SELECT h.conv_id, CASE WHEN h.h = 0 THEN h.s ELSE list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) END AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, s[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
linked AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.p = n.p[1:n.depth - 1]),
sums AS (
  SELECT d AS depth, p[1:d] AS p, CAST(sum(CAST(n_children = 0 AS BIGINT)) AS BIGINT) AS n_leaves,
         CAST(sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * p[depth].words END) AS BIGINT) AS saved_tokens
  FROM linked, unnest(range(0, depth + 1)) AS x(d) GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN sums USING (depth, p)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": PREFIX_TRIE, "op1_substring_dedup": SUBSTRING_DEDUP, "op4_quality_rules": QUALITY_RULES, "op7_ngram_join": NGRAM_JOIN,
            "op9_decontaminate": DECONTAMINATE}
