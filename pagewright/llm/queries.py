"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontamination, fingerprints, licenses, neardup, ppm, quality, substrings, urls, webpages
from .common import spread, table

#: The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: Rows that the classifier may not learn a label from, and those that the language model may not learn from.
UNSEEN_LABEL = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"
UNSEEN_TEXT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.scored(table(spark, sf_dir, "documents"), ~F.expr(UNSEEN_TEXT))
    return found.select("doc_id", F.expr(UNSEEN_TEXT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the longest rule that covers its URL; allow where none does."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.trained(docs, table(spark, sf_dir, "labels"), ~F.expr(UNSEEN_LABEL))
    return quality.scored(docs, *model).select("doc_id", F.expr(UNSEEN_LABEL).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("expressions")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.extracted(spread(table(spark, sf_dir, "pages")))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ppm_scoring, op2_byte_bpe, op3_url_filter, op4_decontamination, op5_quality_classifier, op6_license_scan, op7_html_extraction, op8_imatch_fingerprints, op9_substring_dedup, op10_minhash_near_dedup)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op3_url_filter": rf"""
WITH rules(entry, rule_host, rule_path, ruled) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hits AS (
  SELECT s.page_id, r.entry, r.ruled, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.entry) DESC, length(r.rule_host) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT s.page_id, s.host, s.path, h.entry AS rule, coalesce(h.ruled, 'allow') AS verdict
FROM split s LEFT JOIN hits h ON h.page_id = s.page_id AND h.k = 1""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win SEMI JOIN twice USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cut.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach(u, v) AS (SELECT DISTINCT u, u FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON e.u = r.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.m, d.doc_id) AS component_id, coalesce(least.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.u = d.doc_id""",
}
