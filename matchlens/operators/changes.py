"""Change detection along a series: compaction, gaps, row hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan


def compact_changes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, *, max_rows: int | None = None
) -> DataFrame:
    """Keep a row only when its value differs from the row before.

    Maps cannot be compared; pass `map_value(...)` for those.
    """
    seen = ordered_scan(
        df.withColumn("_value", F.struct(value.alias("v"))), keys, order, {"_prev": ("previous", F.col("_value"))}, max_rows=max_rows
    )
    return seen.where(~F.col("_prev").eqNullSafe(F.col("_value"))).drop("_prev", "_value")


def map_value(column: Column | str) -> Column:
    """A map as a sorted array of entries, which compares by content."""
    return F.array_sort(F.map_entries(F.col(column) if isinstance(column, str) else column))


def frame_gaps(snapshots: DataFrame, keys: Sequence[str] = ("replay_id",), frame: str = "frame", *, max_rows: int | None = None) -> DataFrame:
    """Largest distance between consecutive frames per match, and whether frames were skipped."""
    steps = ordered_scan(snapshots.select(*keys, frame), keys, [frame], {"_prev": ("previous", F.col(frame))}, max_rows=max_rows)
    return steps.groupBy(*keys).agg(
        F.coalesce(F.max(F.col(frame) - F.col("_prev")), F.lit(0)).cast("bigint").alias("max_frame_delta")
    ).withColumn("frames_skipped", F.col("max_frame_delta") > 1)


def finite(value: Column) -> Column:
    """The number, or null when it is missing or not finite."""
    d = value.cast("double") if not isinstance(value, str) else F.col(value).cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def clean_series(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose required numbers are not finite; read other numbers as 0."""
    out = df
    for c in required:
        out = out.withColumn(c, finite(F.expr(f"try_cast(`{c}` as double)"))).where(F.col(c).isNotNull())
    for c in optional:
        out = out.withColumn(c, F.coalesce(finite(F.expr(f"try_cast(`{c}` as double)")), F.lit(0.0)))
    return out


def clean_deaths(df: DataFrame) -> DataFrame:
    """Deaths with a finite time and a category."""
    return clean_series(df, ["time_seconds"]).where(F.coalesce(F.length("category"), F.lit(0)) > 0)


def unique_names(df: DataFrame, base: str, order: Sequence[str], name: str = "unique_name", *, max_rows: int | None = None) -> DataFrame:
    """Number repeated names in order: `x`, `x_2`, `x_3`.

    A name repeated very often is split over tasks when the first order column
    is a number.
    """
    numeric = dict(df.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    ready = df if numeric else df.withColumn("_zero", F.lit(0))
    at = list(order) if numeric else ["_zero", *order]
    placed = ordered_scan(ready, [base], at, {"_n": ("total", F.lit(1).cast("bigint"))}, max_rows=max_rows)
    return placed.withColumn(
        name, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), F.col("_n").cast("string")))
    ).drop("_n", "_zero")
