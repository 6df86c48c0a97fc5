"""Driver queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, exact_dedup, license_scan, line_dedup, mixing, near_dedup, pii, quality_rules, toxicity, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = license_scan.scan_licenses(docs, license_scan.fit(docs))
    sure = F.filter("hits", lambda h: h["confirmed"])
    return scanned.select(
        "doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda h: h["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda h: F.concat_ws(":", h["line"].cast("string"), h["family"])), ",").alias("spans"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op1_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fit AS (
  SELECT p.page_id, p.host, p.path, h || rules.p AS rule, v,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || rules.p) DESC) AS k
  FROM p JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, rules.p)
)
SELECT p.page_id, p.host, p.path, fit.rule AS rule, coalesce(fit.v, 'allow') AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND fit.k = 1
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op6_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS w5, lead(w, 4) OVER o AS fifth FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w5) AS c FROM g WHERE fifth IS NOT NULL),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
dup AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, l ORDER BY p) AS k FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS c FROM w GROUP BY doc_id),
base AS (
  SELECT d.doc_id, source, coalesce(counted.n, 0) AS n_words, coalesce(counted.c, 0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id)
), judged AS (
  SELECT *, (n_words < 10)::INT AS few_words, (100 * n_repeat_words > 20 * n_words)::INT AS repeats, (100 * n_symbols > 10 * n_words)::INT AS symbols FROM base
), hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(few_words)::DOUBLE AS few_words, sum(repeats)::DOUBLE AS repeats, sum(symbols)::DOUBLE AS symbols FROM judged GROUP BY source),
rates AS (
  SELECT source, n, 'few_words' AS rule, few_words AS f FROM hosts UNION ALL SELECT source, n, 'repeats', repeats FROM hosts UNION ALL SELECT source, n, 'symbols', symbols FROM hosts
), moments AS (SELECT rule, sum(n) AS total, count(*) AS h, sum(n * n) AS nn, sum(f) / sum(n) AS m, sum(f * f / n) AS sq FROM rates GROUP BY rule),
spread AS (SELECT *, m * (1 - m) AS v, total - nn / total - (h - 1) AS room FROM moments),
beyond AS (SELECT *, CASE WHEN v > 0 AND room > 0 THEN ((sq - total * m * m) / v - (h - 1)) / room END AS r FROM spread),
prior AS (SELECT *, CASE WHEN r > 0 THEN least(1e6, greatest(1.0, 1 / r - 1)) ELSE 1e6 END AS size FROM beyond),
shrunk AS (SELECT source, n, size, (f + size * m) / (n + size) AS rate, least(0.5, greatest(0.3, m + 2 * sqrt(m * (1 - m) / (size + 1)))) AS lim FROM rates JOIN prior USING (rule)),
bad AS (SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + size + 1)) > lim) AS bad FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words + repeats > 0 AS base_failed, few_words + repeats = 0 AND NOT bad AS kept
FROM judged JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> holder AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2:3].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
