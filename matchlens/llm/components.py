"""Connected components of a link table, by the alternating star method.

Each round hooks every node's neighbours to the smallest node it knows; rounds
are few (they grow with the logarithm of a component's size) and each is written
to the shared folder, which cuts lineage. A node with very many neighbours is
only ever reduced to a minimum (combined before the shuffle) and joined, so no
task has to hold its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """`links` (u, v) of longs, to (node, root) for every node that occurs; root is the component's least node."""
    links = stage(links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    while True:
        # large star: every larger neighbour is linked to the least of the neighbourhood
        near = _both(links)
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours are linked to the least of them
        large = stage(large.where("u > v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.select("u", F.col("m").alias("v"))
        after = stage(moved.unionByName(kept).distinct(), "links")
        # a star forest: every node has one parent and no parent has a parent
        parents = after.select(F.col("v").alias("u")).distinct()
        many = after.groupBy("u").count().where("count > 1").select("u")
        done = after.join(parents, "u", "left_semi").select("u").unionByName(many).isEmpty()
        links = after
        if done:
            break
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
