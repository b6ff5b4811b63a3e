"""The place of every row in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import partitions


def ranked(rows: DataFrame, *keys: Column) -> DataFrame:
    """`rows` with `rank`, from 0, in the order of `keys`, which no two rows share.

    Rows are dealt by ranges of the keys and sorted within them; a row's rank is
    its place in its range and the sizes of the ranges before.
    """
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = stage(dealt.select(*rows.columns, at.alias("_at")), "ranks")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(bases, "_part").select(*rows.columns, place.alias("rank"))
