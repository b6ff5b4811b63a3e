"""Ordered scans per key that survive a hot key.

A window function puts all rows of its partition key into one task. That is
fine for ordinary keys and ruinous when one key holds a third of the table. The
scans here cut every hot key into slices of about equal numbers of rows:

1. count rows per key (partial aggregation, one small row per key and task);
2. rows of keys above `max_rows` are dealt by ranges of (key, order) and written
   with the number of their range, the slice. At most `total_rows / max_rows`
   keys can be hot, which bounds that broadcast;
3. run the window inside (key, slice);
4. bring in what earlier slices contribute (last row, last filled value, or
   sum), aggregated to one row per slice and carried forward over the slices.

Where no key is hot, the window runs as it is, over as many partitions as the
counted rows need. Inputs that are small as a whole
cannot hold a hot key, and skip even the count.

A sliced scan reads its input up to three times. Where scans follow each other
the plan would multiply, so an input that already reads many sources, or is
large and comes from a shuffle, is first written to the shared folder (`hold`).
A later scan by the same keys can go on with the slices of one before
(`keep_slice`) and counts nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

SLICE = "_slice"
MAX_ROWS = 5_000_000
# Rows of ordinary keys that a task of a counted input sorts, about; a share of the bytes packs many more of narrow rows.
TASK_ROWS = 1_000_000
SMALL_INPUT_BYTES = 256 * 1024 * 1024


MAX_SOURCES = 12
SHUFFLED = ("Join", "Aggregate", "Distinct", "Window", "Sort", "RepartitionByExpression")


def is_derived(df: DataFrame) -> bool:
    """Whether a plan shuffles, and so costs more to run again than its rows cost to read."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() in SHUFFLED:
            return True
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return False


def hold(df: DataFrame) -> DataFrame:
    """The same rows; written out first when the plan reads more than a few sources, or shuffles large ones."""
    sources = df._jdf.queryExecution().analyzed().collectLeaves().size()
    return stage(df, "scan") if sources > MAX_SOURCES or not is_small(df) and is_derived(df) else df


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the sources below a plan, as Catalyst knows them, or None."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:
        return None


def is_small(df: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    size = input_bytes(df)
    return size is not None and size <= limit


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys; a null key is a key like any other, and may be hot."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def with_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Add the slice number where a key is hot: null for ordinary keys, ascending along `order` for hot ones.

    Rows of hot keys are dealt by ranges of (keys, order), so slices have about
    as many rows each, also where all rows share a moment and only the
    tie-breaking columns tell them apart. Without a hot key the rows come back as
    they are. `max_rows=None` means the default bound, with small inputs not
    counted.
    """
    if SLICE in df.columns:
        return df
    if max_rows is None and is_small(df):
        return df
    keys, df = list(keys), hold(df)
    bound = max_rows or MAX_ROWS
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, n = counts.agg(F.sum("_n"), F.sum(F.when(F.col("_n") > bound, F.col("_n")))).first()
    if not n:
        parts = -(-(total or 0) // TASK_ROWS)
        return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
    hot = counts.where(F.col("_n") > bound)
    rows = stage(df, "scan")
    # Bounded by pigeonhole: no more than total_rows / max_rows keys are hot.
    hot = F.broadcast(hot.select(*keys))
    ranged = rows.join(hot, _same(rows, hot, keys), "left_semi").repartitionByRange(-(-4 * n // bound), *keys, *order)
    cut = stage(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")), "slices")
    rest = rows.join(hot, _same(rows, hot, keys), "left_anti").withColumn(SLICE, F.lit(None).cast("bigint"))
    return cut.unionByName(rest)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    max_rows: int | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Add columns computed along `order` within `keys`.

    Each output is `(kind, expression)`:

    * `"previous"`: the expression on the row before (null on the first row);
    * `"fill"`: the latest non-null value up to and including this row;
    * `"past"`: the latest non-null value of the rows before;
    * `"total"`: the running sum up to and including this row;
    * `"peak"`: the running maximum up to and including this row.

    With `reverse` the scan runs from the end. The columns of `order` together
    must give every row its own place, or the result on tied rows is arbitrary.
    With `keep_slice` the slices stay as a column, null where no key is hot.
    """
    keys, order = list(keys), list(order)
    sliced = with_slice(df, keys, order, max_rows)
    hot_aware = SLICE in sliced.columns
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    part = keys + ([SLICE] if hot_aware else [])
    base = Window.partitionBy(*part).orderBy(*sort)
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = base.rowsBetween(Window.unboundedPreceding, -1)

    local = {}
    for name, (kind, expr) in outputs.items():
        if kind == "previous":
            local[name] = F.lag(F.struct(expr.alias("v"))).over(base)
        elif kind in ("fill", "past"):
            local[name] = F.last(F.when(expr.isNotNull(), F.struct(expr.alias("v"))), ignorenulls=True).over(upto if kind == "fill" else earlier)
        elif kind == "total":
            local[name] = F.sum(expr).over(upto)
        elif kind == "peak":
            local[name] = F.max(expr).over(upto)
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    if not hot_aware:
        return sliced.select(
            "*",
            *[(c if outputs[n][0] in ("total", "peak") else c["v"]).alias(n) for n, c in local.items()],
            *[F.lit(None).cast("bigint").alias(SLICE)] * keep_slice,
        )

    # One row per hot slice: what it hands on to the slices after it.
    place = F.struct(*[F.col(c) for c in order])
    latest = F.min_by if reverse else F.max_by
    ends = []
    for name, (kind, expr) in outputs.items():
        if kind == "previous":
            ends.append(latest(F.struct(expr.alias("v")), place).alias(name))
        elif kind in ("fill", "past"):
            ends.append(
                latest(F.struct(expr.alias("v")), F.when(expr.isNotNull(), place)).alias(name)
            )
        else:
            ends.append((F.sum if kind == "total" else F.max)(expr).alias(name))
    by_slice = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE).asc())
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, (kind, _) in outputs.items():
        if kind == "previous":
            carried.append(F.lag(name).over(by_slice).alias(f"_carry_{name}"))
        elif kind in ("fill", "past"):
            carried.append(F.last(name, ignorenulls=True).over(before).alias(f"_carry_{name}"))
        else:
            carried.append((F.sum if kind == "total" else F.max)(name).over(before).alias(f"_carry_{name}"))
    carry = (
        sliced.where(F.col(SLICE).isNotNull()).groupBy(*keys, SLICE).agg(*ends).select(*keys, SLICE, *carried)
    )

    rows = sliced.select("*", *[c.alias(f"_local_{n}") for n, c in local.items()])
    joined = rows.join(carry, _same(rows, carry, keys) & (rows[SLICE] == carry[SLICE]), "left").select(
        *[rows[c] for c in rows.columns], *[carry[f"_carry_{n}"] for n in local])
    finals = []
    for name, (kind, _) in outputs.items():
        here, past = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
        if kind == "total":
            value = F.when(here.isNull(), past).when(past.isNull(), here).otherwise(here + past)
        elif kind == "peak":
            value = F.greatest(here, past)
        else:
            value = F.coalesce(here, past)["v"]
        finals.append(value.alias(name))
    kept = [c for c in sliced.columns if keep_slice or c != SLICE]
    return joined.select(*kept, *finals)


def row_place(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, max_rows: int | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return ordered_scan(df, keys, order, {name: ("total", F.lit(1).cast("bigint"))}, max_rows=max_rows)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, place: str = "n") -> DataFrame:
    """The first `n` rows per key with their 1-based place.

    Spark limits each map task to `n` rows per key before the shuffle, so a hot
    key costs `n` rows per task, not all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def text_place(df: DataFrame, column: str, name: str = "_place", ranges: int | None = None) -> DataFrame:
    """A number that grows with the binary order of a text column.

    It is the place of the text's range among ranges that hold about as many rows
    each, whatever the texts look like; texts of one range have equal numbers and
    need the text itself as a tie-break. Without a number of `ranges` Spark joins
    small ones. Lets `ordered_scan` slice an order by text. The rows are written
    once, so that all readers see the same ranges.
    """
    cut = df.repartitionByRange(column) if ranges is None else df.repartitionByRange(ranges, column)
    return stage(cut.withColumn(name, F.spark_partition_id().cast("double")), "ranges")
