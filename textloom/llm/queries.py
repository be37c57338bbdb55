"""The queries of this package over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import bpe, langid, packing, quality, secrets, simhash, substrings, topk, toxicity, warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_langid": op10_langid,
}

STOP_LIST = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS c FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: lower(x) IN ({STOP_LIST}))) AS stops,
             length(array_to_string(words, '')) - length(regexp_replace(array_to_string(words, ''), '\p{{L}}+', '', 'g')) AS letters,
             len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots
      FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_chars,
             stops::DOUBLE / nullif(n_words, 0) AS stop_ratio, letters::DOUBLE / nullif(word_chars, 0) AS letter_ratio, bullets::DOUBLE / nullif(n_lines, 0) AS bullet_line_ratio,
             dots::DOUBLE / nullif(n_lines, 0) AS ellipsis_line_ratio, n_symbols::DOUBLE / nullif(word_chars, 0) AS symbol_ratio, n_dup_lines::DOUBLE / nullif(n_lines, 0) AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"(n_words < {x.least_words} OR coalesce({x.metric} BETWEEN {x.low if x.low is not None else 0} AND {x.high if x.high is not None else 1e9}, true))" for x in quality.RULES)} AS kept,
       mean_word_chars, stop_ratio, letter_ratio, bullet_line_ratio, ellipsis_line_ratio, symbol_ratio, dup_line_ratio
FROM r
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, strlen(h)::BIGINT AS n, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

TOPK_SQL = """
WITH d AS (SELECT DISTINCT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM d),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op2_quality": QUALITY_SQL, "op4_warc": WARC_SQL, "op5_topk": TOPK_SQL}
