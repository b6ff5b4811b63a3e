"""op12: a quarter of the documents of twenty words or more, drawn towards the benchmark's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .resample import resample


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def crc32_sql(blob: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a blob: eight shifts for each byte, as the checksum is defined."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(range(8), lambda c, j: {step}, xor(c, b))"
    data = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE = rf"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS i, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), f AS (
  SELECT side, i, unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS feature FROM w
), b AS (
  SELECT feature, ({crc32_sql("encode(feature)")} % 10000) AS bucket FROM (SELECT DISTINCT feature FROM f)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), d AS (
  SELECT i, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN b USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY i
), scored AS (
  SELECT w.i, doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total / n::DOUBLE), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN d ON w.i = d.i WHERE side = 0
), s AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_words >= 20 AS able FROM scored
), r AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, i) AS place, 25 * sum(able::INT) OVER () // 100 AS k FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= k THEN place END AS rank FROM r
"""
