"""Exact five-number summaries without gathering a group in one task.

The built-in exact `percentile` keeps every distinct value of a group in one
buffer. The distributed form here merges equal values map-side, cuts each
group's range at approximate quantiles, adds up the weight of every cut, and
sorts only the cuts that hold a wanted rank (about one part in 128 each). The
cuts only steer the work: ranks come from exact weights, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import is_small

POINTS = (0.25, 0.5, 0.75)
NAMES = ("p25", "median", "p75")
CUTS = 128


def summary_columns(value: Column, weight: Column | None = None) -> list[Column]:
    """n, min, p25, median, p75, max, mean with the built-in exact percentile."""
    w = weight if weight is not None else F.lit(1)
    present = F.when(value.isNotNull(), w)
    return [
        F.coalesce(F.sum(present), F.lit(0)).cast("bigint").alias("n"),
        F.min(value).alias("min"),
        *[F.percentile(value, F.lit(p), w).alias(n) for p, n in zip(POINTS, NAMES)],
        F.max(value).alias("max"),
        (F.sum(value * w) / F.sum(present)).alias("mean"),
    ]


def summarize(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    weight: str | None = None,
    *,
    distributed: bool | None = None,
) -> DataFrame:
    """One row per group: n, min, p25, median, p75, max, mean (linear interpolation).

    Null values are skipped and a group without values does not appear; with no
    groups an empty input gives one row of nulls with n = 0. A row of weight w
    counts w times. By default small inputs use the built-in aggregate and
    everything else the distributed form.
    """
    by = list(groups) or ["_all"]
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.where(F.col(value).isNotNull())
    if not groups:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"), w.alias("_w"))
    if distributed is None:
        distributed = not is_small(df)
    if not distributed:
        return rows.groupBy(*groups).agg(*summary_columns(F.col("_v"), F.col("_w")))

    distinct = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))
    totals = distinct.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        (F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("mean"),
        F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 10_000).alias("_marks"),
    )
    # Without groups the other side is one row. With groups Spark picks broadcast
    # or shuffle by the actual size, and splits a hot group when it shuffles.
    sized = (lambda side: side) if groups else F.broadcast
    marked = distinct.join(sized(totals.select(*by, "n", "_marks")), by).withColumn(
        "_cut", F.size(F.filter("_marks", lambda m: m < F.col("_v")))
    )
    cuts = marked.groupBy(*by, "_cut").agg(F.sum("_w").alias("_cw"), F.max("n").alias("n"))
    cuts = cuts.withColumn(
        "_before", F.sum("_cw").over(Window.partitionBy(*by).orderBy("_cut")) - F.col("_cw")
    )
    wanted = F.lit(False)
    for p in POINTS:
        for edge in (F.floor, F.ceil):
            rank = edge((F.col("n") - 1) * F.lit(p))
            wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_cw")))
    # At most six cuts per group.
    near = marked.join(sized(cuts.where(wanted).select(*by, "_cut", "_before")), [*by, "_cut"])
    ends = F.col("_before") + F.sum("_w").over(Window.partitionBy(*by, "_cut").orderBy("_v"))
    ranked = near.withColumn("_end", ends)
    picks = []
    for i, p in enumerate(POINTS):
        pos = (F.col("n") - 1) * F.lit(p)
        for tag, edge in (("lo", F.floor), ("hi", F.ceil)):
            picks.append(F.min(F.when(F.col("_end") > edge(pos), F.col("_v"))).alias(f"_{tag}{i}"))
    out = totals.drop("_marks").join(ranked.groupBy(*by).agg(*picks), by)
    blended = []
    for i, p in enumerate(POINTS):
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        blended.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(NAMES[i]))
    out = out.select(*by, "n", "min", *blended, "max", "mean")
    if groups:
        return out
    return out.agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"),
        *[F.max(c).alias(c) for c in ("min", *NAMES, "max", "mean")],
    )
