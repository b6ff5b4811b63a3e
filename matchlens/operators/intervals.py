"""State intervals over time, timeline extent, and lane packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import supply_severity, supply_state
from .ordered import SLICE, ordered_scan, with_slice
from .scope import K

GAP = 5.0
MIN_EXTENT = 300.0
MARGIN = 120.0


def merge_equal(
    df: DataFrame, keys: Sequence[str], state: str = "state", extra: Sequence[Column] = (), *, max_rows: int | None = None, hot: bool | None = None
) -> DataFrame:
    """Join neighbouring intervals (`start`, `end`) of equal state into one.

    Where `df` has slices, `hot` tells whether any row is in one; joined
    intervals then keep the slice in which they start, for the next scan.
    """
    keys = list(keys)
    seen = ordered_scan(df, keys, ["start"], {"_before": ("previous", F.col(state))}, max_rows=max_rows, keep_slice=True)
    changed = F.when(F.col("_before").eqNullSafe(F.col(state)), 0).otherwise(1)
    marked = ordered_scan(seen, keys, ["start"], {"_island": ("total", changed.cast("bigint"))}, max_rows=max_rows, keep_slice=bool(hot))
    first_slice = [F.min(SLICE).alias(SLICE)] if hot else [] if hot is None else [F.lit(None).cast("bigint").alias(SLICE)]
    return (
        marked.groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(state).alias(state), *extra, *first_slice)
        .drop("_island")
    )


def extent(
    replays: DataFrame,
    events: DataFrame | None = None,
    series: Sequence[DataFrame] = (),
    *,
    build_time: str | None = None,
) -> DataFrame:
    """Shown time range per match: at least 300 s, 120 s beyond the last sample or
    finished item; starts 10 s before the first item when that is negative."""
    parts = []
    if events is not None:
        end = F.col("time_seconds") + (F.coalesce(F.col(build_time), F.lit(0.0)) if build_time else F.lit(0.0))
        parts.append(events.groupBy("replay_id").agg(F.max(end).alias("_hi"), F.min("time_seconds").alias("_lo")))
    for df in series:
        parts.append(df.groupBy("replay_id").agg(F.max("time_seconds").alias("_hi"), F.lit(None).cast("double").alias("_lo")))
    rows = None
    for p in parts:
        rows = p if rows is None else rows.unionByName(p)
    both = rows.groupBy("replay_id").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    return replays.select("replay_id").join(both, "replay_id", "left").select(
        "replay_id",
        F.when(F.col("_lo") < 0, F.col("_lo") - 10).otherwise(0.0).alias("range_min"),
        F.greatest(F.lit(MIN_EXTENT), F.greatest(F.lit(0.0), F.coalesce("_hi", F.lit(0.0))) + MARGIN).alias("range_max"),
    )


def supply_intervals(
    supply: DataFrame, ranges: DataFrame, gap: float = GAP, *, max_rows: int | None = None
) -> DataFrame:
    """Supply states over the shown range, per participant.

    Equal neighbours merge; an ok stretch of at most `gap` seconds between two
    non-ok states joins the more severe one (the earlier on a tie), and equal
    neighbours merge again. The first sample's state reaches back to the start.
    """
    t = F.col("time_seconds")
    rows = supply.join(ranges, "replay_id")
    sample = F.struct("current", "max")
    edge = rows.groupBy(*K).agg(
        F.min("range_min").alias("time_seconds"),
        F.min("time_seconds").alias("_t0"),
        F.min_by(sample, F.struct("time_seconds", "frame")).alias("_first"),
        F.max_by(sample, F.when(t <= F.col("range_min"), F.struct("time_seconds", "frame"))).alias("_at"),
        F.max("range_max").alias("range_max"),
    )
    opening = edge.withColumn(
        "_s", F.when(F.col("time_seconds") <= F.col("_t0"), F.col("_first")).otherwise(F.col("_at"))
    ).select(*K, "time_seconds", F.lit(-1).cast("bigint").alias("frame"), F.col("_s")["current"].alias("current"), F.col("_s")["max"].alias("max"), "range_max")
    inner = rows.where((t > F.col("range_min")) & (t < F.col("range_max"))).select(
        *K, "time_seconds", F.col("frame").cast("bigint").alias("frame"), "current", "max", "range_max"
    )
    points = opening.unionByName(inner).withColumn("state", supply_state("current", "max"))
    # All scans go along time within K: the slices of the first serve the others, and rows are shuffled once.
    cut = with_slice(points, K, ["time_seconds", "frame"], max_rows)
    hot = SLICE in cut.columns
    timed = ordered_scan(
        cut if hot else cut.withColumn(SLICE, F.lit(None).cast("bigint")), K, ["time_seconds", "frame"],
        {"_next": ("previous", F.col("time_seconds"))}, reverse=True, max_rows=max_rows, keep_slice=True,
    )
    raw = timed.select(
        *K, SLICE, F.col("time_seconds").alias("start"), F.coalesce("_next", "range_max").alias("end"), "state"
    ).where(F.col("end") > F.col("start"))
    once = merge_equal(raw, K, max_rows=max_rows, hot=hot)
    near = ordered_scan(once, K, ["start"], {"_p": ("previous", F.col("state"))}, max_rows=max_rows, keep_slice=True)
    near = ordered_scan(near, K, ["start"], {"_n": ("previous", F.col("state"))}, reverse=True, max_rows=max_rows, keep_slice=True)
    p, n = supply_severity("_p"), supply_severity("_n")
    absorb = (
        (F.col("state") == "ok")
        & F.col("_p").isNotNull()
        & F.col("_n").isNotNull()
        & (F.col("end") - F.col("start") <= gap)
        & (p > 0)
        & (n > 0)
    )
    absorbed = near.withColumn(
        "state", F.when(absorb, F.when(p >= n, F.col("_p")).otherwise(F.col("_n"))).otherwise(F.col("state"))
    ).drop("_p", "_n")
    return merge_equal(absorbed, K, max_rows=max_rows)


def lanes(
    items: DataFrame,
    keys: Sequence[str] = K,
    *,
    start: str = "time_seconds",
    duration: str = "build_time",
    unit: str = "is_unit",
    ident: str = "event_seq",
    max_rows: int | None = None,
) -> DataFrame:
    """Pack [start, start+duration) into the first free lane, other items above units.

    First-fit depends on order only while something is running. Wherever all
    earlier items are finished every lane is free again, so the timeline is cut
    there by a running maximum, and the pieces are packed independently.
    """
    keys = list(keys)
    s = F.col(start).cast("double")
    rows = items.withColumn("_u", F.col(unit).cast("int")).withColumn("_s", s).withColumn(
        "_e", s + F.col(duration).cast("double")
    )
    by = [*keys, "_u"]
    order = ["_s", ident]
    peaked = ordered_scan(rows, by, order, {"_peak": ("peak", F.col("_e"))}, max_rows=max_rows, keep_slice=True)
    prior = ordered_scan(peaked, by, order, {"_prior": ("previous", F.col("_peak"))}, max_rows=max_rows, keep_slice=True)
    opens = F.when(F.col("_prior").isNull() | (F.col("_s") >= F.col("_prior")), 1).otherwise(0)
    cut = ordered_scan(prior, by, order, {"_piece": ("total", opens.cast("bigint"))}, max_rows=max_rows)
    work = cut.select(*by, "_piece", "_s", "_e", F.col(ident).cast("bigint").alias(ident))
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.select(*by, ident).schema.fields)
    names = [*by, ident, "_lane"]
    width = len(by) + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, running = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row[:width] != piece:
                    piece, running = row[:width], []
                lo, hi, number = row[width:]
                for lane, busy in enumerate(running):
                    busy[:] = [x for x in busy if x[1] > lo]
                    if not any(hi > a for a, _ in busy):
                        break
                else:
                    lane = len(running)
                    running.append([])
                running[lane].append((lo, hi))
                out.append((*row[: width - 1], number, lane))
            yield pd.DataFrame(out, columns=names)

    spread = work.repartition(*by, "_piece").sortWithinPartitions(*by, "_piece", "_s", ident)
    packed = spread.mapInPandas(pack, f"{out_schema}, _lane int")
    above = packed.where(F.col("_u") == 0).groupBy(*keys).agg((F.max("_lane") + 1).alias("_above"))
    return (
        packed.join(above, keys, "left")
        .withColumn("lane", F.col("_lane") + F.when(F.col("_u") == 1, F.coalesce("_above", F.lit(0))).otherwise(0))
        .select(*keys, ident, "lane")
    )
