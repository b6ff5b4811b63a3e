"""op8: every benchmark item that a document contains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .decontaminate import contained_items


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'),
      lambda x: regexp_replace(regexp_replace(x, '^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ''), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$', '')),
    lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'),
      lambda x: regexp_replace(regexp_replace(x, '^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ''), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$', '')),
    lambda x: x <> '') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM bs), ds AS (
  SELECT DISTINCT doc_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS s
  FROM d, sizes WHERE len(w) >= size
), m AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_shingles)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared,
  count(*)::DOUBLE / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (size, s) JOIN m USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""
