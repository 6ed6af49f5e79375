"""Queries of the training-data operators over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import ann, dedup, fingerprints, jaccard, licenses, packing, periods, phrases, pii, quality, spm, urls, warc
from lodestar.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), whole=0)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_documents(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.with_repeats(table(spark, sf_dir, "documents"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_url_filters, op3_approximate_nearest_neighbours, op4_pii, op5_quality_classifier, op6_license_scans, op7_exact_dedup, op8_warc, op9_ngram_jaccard_join, op10_best_fit_packing, op11_document_fingerprints, op12_phrase_collocations, op13_periodic_run_detection)}


OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


OP8 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h
  FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 1000 OR page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""


OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM i),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY ALL),
f AS (
  SELECT lang, w1, NULL AS w2, NULL AS w3, w1 AS phrase, count(*)::HUGEINT AS f FROM x GROUP BY ALL
  UNION ALL SELECT lang, w1, w2, NULL, concat(w1, ' ', w2), count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1, w2, w3, concat(w1, ' ', w2, ' ', w3), count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL),
c AS (SELECT * FROM f WHERE f >= 10 AND w2 IS NOT NULL),
cut AS (
  SELECT lang, phrase, f AS a, 1 AS k, w1 AS head, CASE WHEN w3 IS NULL THEN w2 ELSE concat(w2, ' ', w3) END AS tail FROM c
  UNION ALL SELECT lang, phrase, f, 2, concat(w1, ' ', w2), w3 FROM c WHERE w3 IS NOT NULL),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, h.f AS l, t.f AS r, (1000000 * cut.a * cut.a) // (h.f * t.f) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = cut.head JOIN f t ON t.lang = cut.lang AND t.phrase = cut.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, concat(w1, ' ', w2) AS part, f FROM c WHERE w3 IS NOT NULL UNION ALL SELECT lang, concat(w2, ' ', w3), f FROM c WHERE w3 IS NOT NULL)
  GROUP BY ALL),
z AS (
  SELECT b.* FROM b LEFT JOIN g ON g.lang = b.lang AND g.part = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < 50 * b.a)
SELECT z.lang, row_number() OVER o AS rank, z.phrase, z.a::BIGINT AS a, z.l::BIGINT AS l, z.r::BIGINT AS r, n.n::BIGINT AS n, z.score::BIGINT AS score
FROM z JOIN n ON n.lang = z.lang
WINDOW o AS (PARTITION BY z.lang ORDER BY z.score DESC, z.a DESC, encode(z.phrase))
QUALIFY row_number() OVER o <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7, "op8_warc": OP8, "op12_phrase_collocations": OP12}
