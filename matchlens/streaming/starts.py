"""Build and training starts as snapshots arrive, as set operations on each micro-batch.

`jobs.building_starts` keeps the state of each unit in Spark's state store and
calls Python once per unit and batch, which suits few units and short delays.
Here a batch is joined by the last row of each unit it may follow, and all units
are scanned at once by `ordered_scan`; nothing runs per unit.

    root/found/batch=7   starts and late rows of this batch
    root/state/batch=7   last frame, type, queue and announced target of each unit
    root/marks/batch=7   (watermark): greatest event time up to this batch, less the delay

A batch reads the state of the one before and overwrites only its own folders,
so a batch that is repeated after a failure writes the same again. A unit is
forgotten once the watermark passes its last row by `hold_seconds`; a row that
is older than its unit's last one, or behind the watermark with its unit
unknown, is reported as late.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..operators.reduction import KU, grown
from ..sources.staging import stage
from .late import KEPT_STATES, _batches, _drop

CELLS = ["frame", "unit_type_id", "category", "build_queue_unit_ids", "morph_target_unit_type_id", "morphing_building"]
ORDER = ["_new", "frame"]
FOUND = "array<struct<pos:int,target:int,kind:string,copies:bigint>>"


def _events(first_frame: int, hidden: Sequence[int]) -> Column:
    """What a row of the scan says: the announced target of a unit's state, a late row, or the row's candidates and grown queue."""
    one = lambda pos, target, kind: F.array(F.struct(
        F.lit(pos).alias("pos"), target.alias("target"), kind.alias("kind"), F.lit(1).cast("bigint").alias("copies"))).cast(FOUND)
    none, building = F.array().cast(FOUND), F.lit("building")
    morph, type_id = F.col("morph_target_unit_type_id"), F.col("unit_type_id")
    fresh = F.col("_prev_type").isNull() | (F.col("_prev_type") != type_id)
    own = F.when(morph.isNotNull(), one(-1, morph, building)).when((F.col("category") == "building") & fresh, one(-1, type_id, building)).otherwise(none)
    queued = F.transform(grown(), lambda g, i: F.struct(
        i.alias("pos"), g["target"].alias("target"), F.when(g["target"].between(106, 172), "building").otherwise("unit").alias("kind"),
        g["copies"].cast("bigint").alias("copies"))).cast(FOUND)
    able = F.filter(queued, lambda e: (e["kind"] == "unit") | F.coalesce("morphing_building", F.lit(False)))
    shown = F.concat(own, able)
    if hidden:
        shown = F.filter(shown, lambda e: ~e["target"].isin(*hidden))
    state = F.when(F.col("announced").isNotNull(), one(-1, F.col("announced"), building)).otherwise(none)
    return F.when(F.col("_new") == 0, state).when(F.col("late"), one(-1, type_id, F.col("category"))).when(F.col("frame") > first_frame, shown).otherwise(none)


def find_starts(
    rows: DataFrame, held: DataFrame, mark: int | None = None, *, first_frame: int = 0, hidden: Sequence[int] = (), ts: str = "ts", max_rows: int | None = None
) -> DataFrame:
    """Starts and late rows of a batch: keys, frame, pos, target, kind, copies, late. `held` is the state before it."""
    queue = F.filter(F.coalesce("build_queue_unit_ids", F.array().cast("array<int>")), lambda x: x.isNotNull())
    new = rows.select(*KU, *CELLS, F.unix_micros(ts).alias("at"), F.lit(1).alias("_new"), queue.alias("_q"), F.lit(None).cast("int").alias("announced"))
    old = held.select(
        *KU, *[c if c in held.columns else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in [*CELLS, "at"]],
        F.lit(0).alias("_new"), "_q", "announced")
    with_state = ordered_scan(
        old.unionByName(new), KU, ORDER, {"_held": ("fill", F.when(F.col("_new") == 0, F.col("frame")))}, max_rows=max_rows, keep_slice=True)
    gone = F.lit(False) if mark is None else F.col("_held").isNull() & (F.col("at") <= F.lit(mark))
    judged = with_state.withColumn("late", (F.col("_new") == 1) & (F.coalesce(F.col("frame") < F.col("_held"), F.lit(False)) | gone))
    # late rows are a run of their own, so they are never the row before
    steps = ordered_scan(judged, [*KU, "late"], ORDER, {
        "_prev_type": ("previous", F.col("unit_type_id")),
        "_prev": ("previous", F.when((F.col("_new") == 0) | (F.col("frame") > first_frame), F.col("_q"))),
    }, max_rows=max_rows, keep_slice=True)
    told = steps.withColumn("e", _events(first_frame, hidden)).where(F.size("e") > 0).select(*KU, "late", "_slice", *ORDER, F.inline("e"))
    seen = ordered_scan(told, [*KU, "late", "kind"], [*ORDER, "pos"], {"_last": ("previous", F.col("target"))}, max_rows=max_rows)
    kept = F.col("late") | (F.col("kind") == "unit") | ~F.col("_last").eqNullSafe(F.col("target"))
    return seen.where((F.col("_new") == 1) & kept).select(*KU, "frame", "pos", "target", "kind", "copies", "late")


def next_state(
    rows: DataFrame, held: DataFrame, found: DataFrame, mark: int | None = None, *, first_frame: int = 0, ts: str = "ts"
) -> DataFrame:
    """The state after a batch: each unit's last row, and the target announced last.

    Rows behind the watermark count for units that are known; those of unknown units were late.
    """
    queue = F.filter(F.coalesce("build_queue_unit_ids", F.array().cast("array<int>")), lambda x: x.isNotNull())
    row = F.struct("frame", "unit_type_id", F.when(F.col("frame") > first_frame, queue).otherwise(F.array().cast("array<int>")).alias("_q"),
                   F.unix_micros(ts).alias("at"))
    in_time = F.lit(True) if mark is None else F.coalesce(F.unix_micros(ts) > F.lit(mark), F.lit(True))
    place = lambda n, pos: F.struct(F.col("frame"), n.alias("n"), pos.alias("pos")).alias("place")
    new = rows.select(*KU, row.alias("row"), place(F.lit(1), F.lit(0)), F.lit(None).cast("int").alias("announced"), in_time.alias("counts"))
    old = held.select(
        *KU, F.struct("frame", "unit_type_id", "_q", "at").alias("row"), place(F.lit(0), F.lit(0)), "announced", F.lit(True).alias("counts"))
    told = found.where(~F.col("late") & (F.col("kind") == "building")).select(
        *KU, F.lit(None).cast(new.schema["row"].dataType).alias("row"), place(F.lit(1), F.col("pos")), F.col("target").alias("announced"), F.lit(False).alias("counts"))
    is_row = F.col("row").isNotNull()
    out = old.unionByName(new).unionByName(told).groupBy(*KU).agg(
        F.max_by("row", F.when(is_row, F.col("place"))).alias("any"),
        F.max_by("row", F.when(is_row & F.col("counts"), F.col("place"))).alias("timely"),
        F.max_by("announced", F.when(F.col("announced").isNotNull(), F.col("place"))).alias("announced"),
        F.bool_or(is_row & (F.col("place.n") == 0)).alias("known"),
    )
    return out.select(*KU, F.when(F.col("known"), F.col("any")).otherwise(F.col("timely")).alias("row"), "announced").where(
        F.col("row").isNotNull()).select(*KU, "row.*", "announced")


def take_batch(
    root: str, *, transient_ids: Sequence[int] = (), first_frame: int = 0, ts: str = "ts", delay_seconds: int = 600, hold_seconds: int = 600
) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch, for `foreachBatch`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch.select(*KU, *CELLS, ts), "batch")
        before = [b for b in _batches(spark, root, "marks") if b < batch_id]
        mark = spark.read.parquet(f"{root}/marks/batch={before[-1]}").first()[0] if before else None
        types = dict(rows.dtypes)
        layout = {**{k: types[k] for k in [*KU, "frame", "unit_type_id"]}, "_q": "array<int>", "at": "bigint", "announced": "int"}
        held = (
            spark.read.schema(", ".join(f"{c} {x}" for c, x in layout.items())).parquet(f"{root}/state/batch={before[-1]}") if before
            else spark.range(0).select(*[F.lit(None).cast(x).alias(c) for c, x in layout.items()])
        )
        here = f"{root}/found/batch={batch_id}"
        found = find_starts(rows, held, mark, first_frame=first_frame, hidden=transient_ids, ts=ts)
        found.write.mode("overwrite").parquet(here)
        newest = rows.agg(F.unix_micros(F.max(ts))).first()[0]
        now = max([m for m in (mark, None if newest is None else newest // 1000 * 1000 - delay_seconds * 1_000_000) if m is not None], default=None)
        state = next_state(rows, held, spark.read.schema(found.schema).parquet(here), mark, first_frame=first_frame, ts=ts)
        if now is not None:
            state = state.where(F.col("at") + hold_seconds * 1_000_000 > F.lit(now))
        state.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")
        spark.range(1).select(F.lit(now).cast("bigint").alias("watermark")).write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")  # last: the batch is whole
        for old in [b for b in _batches(spark, root, "state") if b < batch_id - KEPT_STATES]:
            _drop(spark, f"{root}/state/batch={old}")

    return run


def start(rows: DataFrame, root: str, checkpoint: str, *, trigger: dict | None = None, **kw):
    """Run the stream `rows` of units into the folders under `root`; returns the started query."""
    return (
        rows.writeStream.foreachBatch(take_batch(root, **kw)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def starts(spark: SparkSession, root: str) -> DataFrame:
    """All starts and late rows found so far, with the batch that brought them."""
    return spark.read.option("basePath", f"{root}/found").parquet(f"{root}/found")
