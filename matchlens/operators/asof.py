"""Latest sample at or before a time: at one time for all, or at each row's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan

SAMPLE = "sample"


def asof_const(
    samples: DataFrame,
    keys: Sequence[str],
    at: float,
    payload: Sequence[str],
    *,
    time: str = "time_seconds",
    tie: Sequence[str] = (),
    name: str = SAMPLE,
) -> DataFrame:
    """Per key, the struct of the latest sample with time <= `at`.

    The filter reaches the scan and the aggregate combines map-side, so a hot
    key costs one row per task. The whole row is picked first, so a null field
    of the latest sample stays null.
    """
    return (
        samples.where(F.col(time) <= at)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(time, *payload), F.struct(time, *tie)).alias(name))
    )


def latest_when(cond: Column, payload: Sequence[str], order: Sequence[str]) -> Column:
    """Aggregate: struct of the last row (by `order`) for which `cond` holds."""
    return F.max_by(F.struct(*payload), F.when(cond, F.struct(*order)))


def _tagged(samples, probes, keys, payload, time, probe_time, tie):
    carried = [c for c in probes.columns if c not in keys]
    s = samples.select(
        *keys,
        F.col(time).cast("double").alias("_t"),
        F.lit(0).alias("_side"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).cast("double") for c in tie]).alias("_tie"),
        F.struct(time, *payload).alias("_sample"),
        F.lit(None).cast(probes.select(F.struct(*carried).alias("p")).schema["p"].dataType).alias("_probe"),
    )
    p = probes.select(
        *keys,
        F.col(probe_time).cast("double").alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(s.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(s.schema["_sample"].dataType).alias("_sample"),
        F.struct(*carried).alias("_probe"),
    )
    return s.unionByName(p), carried


def asof_rows(
    samples: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    *,
    time: str = "time_seconds",
    probe_time: str = "time_seconds",
    tie: Sequence[str] = (),
    following: bool = False,
    clamp: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Each probe row with `sample`, the latest sample at or before its own time.

    Samples and probes are united and filled forward in one ordered scan, so
    rows never multiply. Equal times count as "at". `following` adds `next`,
    the first sample at or after the probe; `clamp` falls back to the earliest
    sample when the probe lies before it.
    """
    keys = list(keys)
    rows, carried = _tagged(samples, probes, keys, payload, time, probe_time, tie)
    order = ["_t", "_side", "_tie"]
    scanned = ordered_scan(
        rows, keys, order, {SAMPLE: ("fill", F.col("_sample"))}, max_rows=max_rows
    )
    if following or clamp:
        # Backwards a sample at the probe's own time must come before the probe.
        scanned = scanned.withColumn("_back", -F.col("_side"))
        scanned = ordered_scan(
            scanned, keys, ["_t", "_back", "_tie"], {"next": ("fill", F.col("_sample"))}, reverse=True, max_rows=max_rows
        )
    out = scanned.where(F.col("_side") == 1)
    if clamp:
        out = out.withColumn(SAMPLE, F.coalesce(SAMPLE, "next"))
    extra = ["next"] if following else []
    return out.select(*keys, *[F.col("_probe")[c].alias(c) for c in carried], SAMPLE, *extra)


def step_sample(samples, probes, keys, payload, **kw) -> DataFrame:
    """Like `asof_rows`, but a probe before the first sample takes the first one."""
    return asof_rows(samples, probes, keys, payload, clamp=True, **kw)


def interpolate(
    samples: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    time: str = "time_seconds",
    probe_time: str = "time_seconds",
    tie: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Values between the neighbouring samples, held flat beyond both ends."""
    found = asof_rows(
        samples, probes, keys, values, time=time, probe_time=probe_time, tie=tie, following=True, max_rows=max_rows
    )
    lo, hi = F.col(SAMPLE), F.col("next")
    span = (hi[time] - lo[time]).cast("double")
    share = F.when(span > 0, (F.col(probe_time).cast("double") - lo[time].cast("double")) / span).otherwise(F.lit(0.0))
    cols = []
    for v in values:
        a, b = lo[v].cast("double"), hi[v].cast("double")
        cols.append(
            F.when(lo.isNull() | (hi[time] == F.col(probe_time)), b)
            .when(hi.isNull(), a)
            .otherwise(a + (b - a) * share)
            .alias(v)
        )
    return found.select(*[c for c in found.columns if c not in (SAMPLE, "next")], *cols)
