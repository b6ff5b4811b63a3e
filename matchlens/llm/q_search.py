"""op11: the five highest inner products of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .pivot_search import top_k


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score, c.i AS other
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.i <> q.i
)
SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
