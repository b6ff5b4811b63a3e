"""Windows and sessions over a stream that lose no row: what comes too late goes to a side table.

Spark's own window aggregates drop a row whose window has closed, and no query
can ask for it. Here a micro-batch is merged with the windows that are still
open: rows whose window ends at or before the watermark go to `late`, windows
that the new watermark closes go to `closed`, and the rest is the state of the
next batch. All of it are DataFrame aggregates; no task holds a key.

    root/marks/batch=7   (watermark): greatest event time up to this batch, less the delay
    root/open/batch=7    windows that a later batch may change, with `ended` where they end at or before the watermark
    root/closed/batch=7  windows settled by this batch
    root/late/batch=7    its rows that came too late, with all their columns

A batch reads the state of the one before and overwrites only its own folders,
so a batch that is repeated after a failure writes the same again. The rows of
closed, open and late windows add up to the rows of the stream. A row without an
event time is late. State is `open` alone; older states are deleted.

A session may be joined for one gap after it has ended, by a row that is not
late itself and no further away than the gap. It counts as closed, but stays in
`open` until no such row can come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..sources.staging import stage

#: States kept besides the newest, for a batch that is repeated.
KEPT_STATES = 2


@dataclass(frozen=True)
class Windows:
    """Tumbling windows of a width, in seconds."""

    keys: tuple[str, ...]
    ts: str = "ts"
    seconds: int = 5

    columns = ("window_start", "window_end", "losses")

    def ends(self) -> Column:
        return F.col("window_end")

    def settled(self) -> Column:
        return self.ends()

    def row_end(self) -> Column:
        """As `window` has it, but null where the time is: `window` would drop the row."""
        width = F.lit(self.seconds * 1_000_000)
        at = F.unix_micros(self.ts)
        return F.timestamp_micros(at - F.pmod(at, width) + width)

    def of_rows(self, rows: DataFrame) -> DataFrame:
        w = F.window(self.ts, f"{self.seconds} seconds")
        return rows.groupBy(*self.keys, w.alias("w")).agg(F.count(F.lit(1)).alias("losses")).select(
            *self.keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "losses")

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys, "window_start", "window_end").agg(F.sum("losses").alias("losses"))


@dataclass(frozen=True)
class Sessions:
    """Runs of rows of a key at most `seconds` apart; a distance of exactly that stays inside."""

    keys: tuple[str, ...]
    ts: str = "ts"
    seconds: int = 15

    columns = ("first_ts", "last_ts", "losses")

    def _after(self, at: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(at) + F.lit(self.seconds * 1_000_000))

    def ends(self) -> Column:
        return self._after(F.col("last_ts"))

    def settled(self) -> Column:
        """One gap after the end: rows in time are then more than a gap away."""
        return self._after(self.ends())

    def row_end(self) -> Column:
        return self._after(F.col(self.ts))

    def of_rows(self, rows: DataFrame) -> DataFrame:
        return self.merged(rows.select(
            *self.keys, F.col(self.ts).alias("first_ts"), F.col(self.ts).alias("last_ts"), F.lit(1).cast("bigint").alias("losses")))

    def merged(self, parts: DataFrame) -> DataFrame:
        """Intervals that touch within the gap become one: ordered scans for the greatest end before each, then a sum."""
        keys, order = list(self.keys), ["_at", "_end"]
        # equal intervals are one row, so that the order leaves no ties
        parts = parts.groupBy(*keys, "first_ts", "last_ts").agg(F.sum("losses").alias("losses"))
        timed = parts.withColumns({"_at": F.unix_micros("first_ts"), "_end": F.unix_micros("last_ts")})
        reached = ordered_scan(timed, keys, order, {"_reach": ("peak", F.col("_end"))})
        before = ordered_scan(reached, keys, order, {"_before": ("previous", F.col("_reach"))})
        starts = F.col("_before").isNull() | (F.col("_at") - F.col("_before") > self.seconds * 1_000_000)
        numbered = ordered_scan(before.withColumn("_new", starts.cast("long")), keys, order, {"_run": ("total", F.col("_new"))})
        return numbered.groupBy(*keys, "_run").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("losses").alias("losses")).drop("_run")


def _batches(spark: SparkSession, root: str, kind: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merge_batch(kind: Windows | Sessions, root: str, delay_seconds: int = 600) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch, for `foreachBatch`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch, "batch")
        before = [b for b in _batches(spark, root, "marks") if b < batch_id]
        mark = spark.read.parquet(f"{root}/marks/batch={before[-1]}").first()[0] if before else None
        held = spark.read.parquet(f"{root}/open/batch={before[-1]}") if before else None
        newest = rows.agg(F.unix_micros(F.max(kind.ts))).first()[0]
        # the engine's own watermark has milliseconds
        now = max([m for m in (mark, None if newest is None else newest // 1000 * 1000 - delay_seconds * 1_000_000) if m is not None], default=None)
        end = F.unix_micros(kind.row_end())
        late = F.col(kind.ts).isNull() if mark is None else F.col(kind.ts).isNull() | (end <= F.lit(mark))
        rows.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        parts = kind.of_rows(rows.where(~late))
        all_open = stage(parts if held is None else kind.merged(held.select(*parts.columns).unionByName(parts)), "windows")
        by_now = lambda at: F.lit(False) if now is None else F.unix_micros(at) <= F.lit(now)
        closes = by_now(kind.settled())
        all_open.where(closes).write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
        all_open.where(~closes).withColumn("ended", by_now(kind.ends())).write.mode("overwrite").parquet(f"{root}/open/batch={batch_id}")
        spark.createDataFrame([(now,)], "watermark long").write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")  # last: the batch is whole
        for old in [b for b in _batches(spark, root, "open") if b < batch_id - KEPT_STATES]:
            _drop(spark, f"{root}/open/batch={old}")

    return run


def start(rows: DataFrame, kind: Windows | Sessions, root: str, checkpoint: str, *, delay_seconds: int = 600, trigger: dict | None = None):
    """Run the stream `rows` into the folders under `root`; returns the started query."""
    return (
        rows.writeStream.foreachBatch(merge_batch(kind, root, delay_seconds)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _state(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/open/batch={_batches(spark, root, 'marks')[-1]}")


def closed(spark: SparkSession, root: str) -> DataFrame:
    """All windows that have ended; a session's last batches may still join it to another."""
    settled = spark.read.option("basePath", f"{root}/closed").parquet(f"{root}/closed").drop("batch")
    return settled.unionByName(_state(spark, root).where("ended").drop("ended"))


def late(spark: SparkSession, root: str) -> DataFrame:
    """All rows that came after their window had closed, with the batch that brought them."""
    return spark.read.option("basePath", f"{root}/late").parquet(f"{root}/late")


def still_open(spark: SparkSession, root: str) -> DataFrame:
    """Windows that have not ended."""
    return _state(spark, root).where("not ended").drop("ended")

