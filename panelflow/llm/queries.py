"""Registered queries of the subpackage, over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm.alignment import align
from panelflow.llm.bpe import encode
from panelflow.llm.exact_dedup import exact_dedup
from panelflow.llm.html_text import extract_text
from panelflow.llm.licenses import license_scan, license_sql
from panelflow.llm.mixing import mix
from panelflow.llm.quality import quality_report
from panelflow.llm.shingle_join import shingle_join
from panelflow.llm.simhash import simhash_dedup
from panelflow.llm.substring_dedup import substring_dedup
from panelflow.llm.token_files import token_file_report
from panelflow.llm.url_templates import page_evidence, url_filter
from panelflow.llm.vector_codes import vector_codes, vector_codes_sql

#: The explicit rules of op3 (fixed values).
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES, bad=page_evidence(F.col("url"), F.col("html")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"), width=4)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                  outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), outputs=("kept_sha256",))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_url_templates": op3_url_templates,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_shingle_join": op12_shingle_join,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op5_license_scan": license_sql(),
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d) p),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) q WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM d) p) q),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM grams WHERE n > 1) r GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d) l),
judged AS (
  SELECT doc_id, line, len(array_to_string(w, '')) AS chars,
    (len(w) < 8 AND NOT regexp_matches(line, '[.!?:;…。！？؟।]["''”’»)\]]*[\x20\x09-\x0D]*$'))
    OR len(list_filter(w, lambda x: regexp_matches(x, '[!?#*$%&~^=_]{2,}$'))) > 0.3::DOUBLE * len(w)
    OR len(list_filter(w, lambda x: regexp_full_match(x, '[|»«›‹·•>/\\-]+'))) > 0.2::DOUBLE * len(w)
    OR regexp_matches(line, '(?i)\b(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|javascript is (?:disabled|required)|click here to|sign up for our newsletter|subscribe to our|skip to (?:main )?content|powered by|share on (?:facebook|twitter)|lorem ipsum)\b') AS fails
  FROM lines WHERE len(w) > 0),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost
  FROM judged GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    CASE WHEN len(words) > 0 THEN lost::DOUBLE / len(array_to_string(words, '')) ELSE 0.0::DOUBLE END AS lost_share
  FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeated USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND lost_share <= 0.5 AS kept FROM based""",
    "op13_vector_codes": vector_codes_sql(),
}
