"""Losses in closed time windows: rows, histograms, both-side summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import per_match
from .scope import K, selfs

DEATH = ["frame", "time_seconds", "dead_owner", "unit_type", "category"]


def in_window(deaths: DataFrame, lo: float, hi: float) -> DataFrame:
    return deaths.where(F.col("time_seconds").between(lo, hi))


def losses_between(deaths: DataFrame, targets: DataFrame, lo: float, hi: float, *, nested: bool = False) -> DataFrame:
    """Deaths of each target within [lo, hi], as rows; a target without any keeps one
    row of nulls. `nested` gathers them per target instead (an empty array when
    there are none), for windows known to be short."""
    rows = in_window(deaths, lo, hi).select(*K, *DEATH)
    if not nested:
        return targets.join(rows, K, "left")
    grouped = rows.groupBy(*K).agg(
        F.array_sort(F.collect_list(F.struct("time_seconds", "frame", "dead_owner", "unit_type", "category"))).alias("deaths")
    )
    return targets.join(grouped, K, "left").withColumn(
        "deaths",
        F.coalesce("deaths", F.array().cast(grouped.schema["deaths"].dataType)),
    )


def loss_histograms(deaths: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Per key: total, first and last time, counts by unit type and by category.

    Counting by (key, unit, category) first leaves one row per distinct pair,
    so the maps are as large as the vocabulary, however many deaths there are.
    """
    keys = list(keys)
    cells = deaths.groupBy(*keys, "unit_type", "category").agg(
        F.count(F.lit(1)).alias("c"), F.min("time_seconds").alias("t0"), F.max("time_seconds").alias("t1")
    )
    pairs = F.collect_list(F.struct("unit_type", "category", "c"))
    return cells.groupBy(*keys).agg(
        F.sum("c").alias("total_count"),
        F.min("t0").alias("first_time"),
        F.max("t1").alias("last_time"),
        fold_counts(pairs, "unit_type").alias("by_unit_type"),
        fold_counts(pairs, "category").alias("by_category"),
    )


def fold_counts(pairs: Column, dim: str) -> Column:
    """Map from a field of (unit_type, category, c) structs to the sum of c."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[dim])))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.aggregate(
                    F.filter(pairs, lambda p: p[dim] == n), F.lit(0).cast("bigint"), lambda acc, p: acc + p["c"]
                ).alias("value"),
            ),
        )
    )


def death_summary(deaths: DataFrame, parts: DataFrame, lo: float, hi: float) -> DataFrame:
    """Losses and kills by unit over the scope, with means per scope row.

    `parts` comes from `scope.participants`. Each death counts once per scope
    row that has its owner as self (lost) or as opponent (killed).
    """
    rows = in_window(deaths, lo, hi).select(*K, "unit_type")
    per_unit = rows.groupBy(*K, "unit_type").agg(F.count(F.lit(1)).alias("c"))
    sides = (
        per_unit.join(parts.select(*K, "as_self", "as_opponent"), K)
        .groupBy("unit_type")
        .agg(F.sum(F.col("c") * F.col("as_self")).alias("lost"), F.sum(F.col("c") * F.col("as_opponent")).alias("killed"))
    )
    size = selfs(parts).agg(F.coalesce(F.sum("as_self"), F.lit(0)).cast("bigint").alias("sample_size"))
    long = sides.select(
        F.col("unit_type").alias("unit"),
        F.explode(F.create_map(F.lit("lost"), "lost", F.lit("killed"), "killed")).alias("side", "count"),
        F.lit(0).alias("_one"),
    ).where(F.col("count") > 0)
    # One row.
    joined = long.join(F.broadcast(size.withColumn("_one", F.lit(0))), "_one")
    return joined.select(
        "side", "unit", "count", "sample_size", per_match(F.col("count"), F.col("sample_size")).alias("per_match_mean")
    )


def pair_losses(deaths: DataFrame, scope_rows: DataFrame, lo: float, hi: float, limit: int = 5) -> DataFrame:
    """Example rows: the first scope rows with their lost and killed counts by unit."""
    cut = scope_rows.orderBy("replay_id", "self_owner", F.col("opponent_owner").asc_nulls_first()).limit(limit)
    rows = in_window(deaths, lo, hi).groupBy(*K, "unit_type").agg(F.count(F.lit(1)).alias("c"))
    hist = rows.join(cut.select("replay_id").distinct(), "replay_id", "left_semi").groupBy(*K).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit_type", "c")))).alias("h")
    )
    mine = hist.select("replay_id", F.col("owner").alias("self_owner"), F.col("h").alias("lost"))
    theirs = hist.select("replay_id", F.col("owner").alias("opponent_owner"), F.col("h").alias("killed"))
    return cut.join(mine, ["replay_id", "self_owner"], "left").join(theirs, ["replay_id", "opponent_owner"], "left")
