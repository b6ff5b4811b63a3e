"""op13: every node of the trie of all rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .prefix_trie import trie
from .q_resample import crc32_sql


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, ({crc32_sql("encode(conv_id::VARCHAR)")} % 4)::BIGINT AS h FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(o.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN c o ON o.conv_id = h.conv_id - h.conv_id % 20
), p AS (
  SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d, turns FROM r
), m AS (
  SELECT conv_id, n, d, list_slice(turns, 1, d) AS prefix, list_slice(turns, 1, d - 1) AS above,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p
), nodes AS (
  SELECT d, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY d, prefix
), kids AS (
  SELECT d - 1 AS d, above AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), under AS (
  SELECT a.d, a.prefix, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) b
  JOIN nodes a ON a.d = b.up AND a.prefix = list_slice(b.prefix, 1, b.up)
  LEFT JOIN kids k ON k.d = b.d AND k.prefix = b.prefix GROUP BY a.d, a.prefix
)
SELECT x.conv_id, x.d AS depth, CASE WHEN x.d > 0 THEN u.conv_id END AS parent_conv_id, x.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  t.n_leaves, t.saved_tokens, x.ends_sha256
FROM nodes x JOIN under t ON t.d = x.d AND t.prefix = x.prefix
LEFT JOIN nodes u ON u.d = x.d - 1 AND u.prefix = x.above
LEFT JOIN kids k ON k.d = x.d AND k.prefix = x.prefix
"""
