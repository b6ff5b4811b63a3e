"""Incremental forms of the operators on Structured Streaming.

Late-data policy: rows more than the watermark delay behind are dropped by the
window aggregates here (`late.py` has windows and sessions that keep them in a
side table); the keyed operators report a row older than what they have already
seen as `late`, for a side table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import loss_lane
from ..sources.bundles import ARCHIVE_MISSING, latest_manifests, parse_manifests, read_matches, texts_of
from ..sources.files import few_listing_tasks
from ..sources.sinks import write_tables
from ..sources.staging import stage

DELAY = "10 minutes"
HOLD_MS = 600_000
#: What the binary file source reports; contents are read only where they are selected.
FILE_LISTING = "path string, modificationTime timestamp, length long, content binary"
#: Files of one batch of the ingest stream. A batch costs a commit over all tables, so large backlogs take large batches;
#: the driver holds their names, some 200 bytes each.
PER_TRIGGER = 20_000


def loss_windows(
    events: DataFrame, keys: Sequence[str], *, ts: str = "ts", width: str = "5 seconds", delay: str = DELAY
) -> DataFrame:
    """Counts per key and tumbling window."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("losses"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "losses")
    )


def loss_lanes(deaths: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """`loss_windows` per lane of the death categories."""
    rows = deaths.withColumn("lane", loss_lane("category")).where(F.col("lane").isNotNull())
    return loss_windows(rows, [*keys, "lane"], **kw)


def loss_sessions(
    events: DataFrame, keys: Sequence[str], *, ts: str = "ts", gap: str = "15 seconds", delay: str = DELAY
) -> DataFrame:
    """Counts per key and run of events; a distance of exactly the gap stays inside."""
    return (
        events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("losses"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(*keys, "first_ts", "last_ts", "losses")
    )


def _ordered(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in time order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")


def changed_values(
    rows: DataFrame, keys: Sequence[str], value: str, *, frame: str = "frame", ts: str = "ts", delay: str = DELAY, hold_ms: int = HOLD_MS
) -> DataFrame:
    """Emit a row only when its value differs from the last one of its key.

    State per key is one value and one frame, dropped when the watermark passes
    the key's last row by `hold_ms`.
    """
    keys = list(keys)
    types = dict(rows.dtypes)
    out = ", ".join([*[f"{k} {types[k]}" for k in keys], f"{frame} bigint", f"{value} {types[value]}", "late boolean"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_frame, last = state.get if state.exists else (None, None)
        found, newest = [], 0
        for row in _ordered(batches, [frame]).itertuples(index=False):
            at, now = int(getattr(row, frame)), getattr(row, value)
            newest = max(newest, int(getattr(row, ts).timestamp() * 1000))
            if last_frame is not None and at < last_frame:
                found.append((*key, at, now, True))
                continue
            if last_frame is None or now != last:
                found.append((*key, at, now, False))
            last_frame, last = at, now
        state.update((last_frame, last))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + hold_ms)
        yield pd.DataFrame(found, columns=[*keys, frame, value, "late"])

    return (
        rows.withWatermark(ts, delay).select(*keys, frame, value, ts).groupBy(*keys)
        .applyInPandasWithState(step, out, f"f bigint, v {types[value]}", "append", GroupStateTimeout.EventTimeTimeout)
    )


def building_starts(
    units: DataFrame, *, transient_ids: Sequence[int] = (), first_frame: int = 0, ts: str = "ts", delay: str = DELAY, hold_ms: int = HOLD_MS
) -> DataFrame:
    """Build and training starts as snapshots arrive, keyed per unit.

    `units` has replay_id, owner, unit_id, frame, unit_type_id, category,
    build_queue_unit_ids, morph_target_unit_type_id, morphing_building and a
    timestamp. State per unit: last frame, type, queue and announced target.
    Nothing is announced for the first frame, and its queues are not kept.
    Output (kind "building" or "unit") carries ids; join names afterwards.
    """
    keys = ["replay_id", "owner", "unit_id"]
    types = dict(units.dtypes)
    hidden = set(transient_ids)
    out = ", ".join([f"{k} {types[k]}" for k in keys]) + ", frame bigint, target int, kind string, late boolean"

    def queue_of(value) -> list[int]:
        return [int(x) for x in value if x is not None] if value is not None else []

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_frame, last_type, last_queue, announced = state.get if state.exists else (None, None, [], None)
        last_queue = list(last_queue or [])
        found, newest = [], 0
        for row in _ordered(batches, ["frame"]).itertuples(index=False):
            at, kind = int(row.frame), int(row.unit_type_id)
            newest = max(newest, int(getattr(row, ts).timestamp() * 1000))
            if last_frame is not None and at < last_frame:
                found.append((*key, at, kind, row.category, True))
                continue
            if at > first_frame:
                candidates = []
                if not pd.isna(row.morph_target_unit_type_id):
                    candidates.append(int(row.morph_target_unit_type_id))
                elif row.category == "building" and last_type != kind:
                    candidates.append(kind)
                queue = queue_of(row.build_queue_unit_ids)
                for target in dict.fromkeys(queue):
                    copies = queue.count(target) - last_queue.count(target)
                    if copies <= 0 or target in hidden:
                        continue
                    if 106 <= target <= 172:
                        if row.morphing_building:
                            candidates.append(target)
                    else:
                        found += [(*key, at, target, "unit", False)] * copies
                for target in candidates:
                    if target != announced and target not in hidden:
                        announced = target
                        found.append((*key, at, target, "building", False))
                last_queue = queue
            last_frame, last_type = at, kind
        state.update((last_frame, last_type, last_queue, announced))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + hold_ms)
        yield pd.DataFrame(found, columns=[*keys, "frame", "target", "kind", "late"])

    wanted = [
        *keys, "frame", "unit_type_id", "category", "build_queue_unit_ids", "morph_target_unit_type_id", "morphing_building", ts
    ]
    return (
        units.withWatermark(ts, delay).select(*wanted).groupBy(*keys)
        .applyInPandasWithState(
            step, out, "f bigint, t int, q array<int>, a int", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def research_starts(
    units: DataFrame, *, stride: int = 1, first_frame: int = 0, ts: str = "ts", delay: str = DELAY, hold_ms: int = HOLD_MS
) -> DataFrame:
    """Upgrades and research that were not in progress one snapshot (`stride`) before."""
    kinds = F.array(
        F.struct(F.lit("upgrade").alias("kind"), F.col("upgrade_in_progress").alias("ident")),
        F.struct(F.lit("tech").alias("kind"), F.col("tech_in_progress").alias("ident")),
    )
    rows = units.select("replay_id", "owner", "frame", ts, F.explode(kinds).alias("r")).select(
        "replay_id", "owner", "frame", ts, "r.kind", "r.ident"
    ).where(F.col("ident").isNotNull())
    keys = ["replay_id", "owner", "kind", "ident"]
    types = dict(rows.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", frame bigint, late boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        found, newest = [], 0
        for row in _ordered(batches, ["frame"]).itertuples(index=False):
            at = int(row.frame)
            newest = max(newest, int(getattr(row, ts).timestamp() * 1000))
            if last is not None and at < last:
                found.append((*key, at, True))
                continue
            if at > first_frame and (last is None or at - last > stride):
                found.append((*key, at, False))
            last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + hold_ms)
        yield pd.DataFrame(found, columns=[*keys, "frame", "late"])

    return (
        rows.withWatermark(ts, delay).groupBy(*keys)
        .applyInPandasWithState(step, out, "f bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def analysis_stream(spark: SparkSession, root: str, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """Paths of new manifests and archives below a folder, each seen once per checkpoint; no contents."""
    few_listing_tasks(spark)
    return (
        spark.readStream.format("binaryFile").schema(FILE_LISTING)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "{manifest.json,*.zip}")
        .option("maxFilesPerTrigger", per_trigger).load(root).select(F.col("path").alias("path"))
    )


def _plain(path: Column | str) -> Column:
    """File sources report file:/x or file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def open_manifests(spark: SparkSession, corpus_root: str, before: int | None = None) -> DataFrame | None:
    """Manifests that wait for an archive, after the last batch (or the last before a batch)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{corpus_root}/_open")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    # a folder counts once Spark has marked it as whole
    done = [f.getPath() for f in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    numbers = sorted(int(p.getName().removeprefix("batch=")) for p in done)
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{corpus_root}/_open/batch={numbers[-1]}") if numbers else None


def current_errors(spark: SparkSession, corpus_root: str) -> DataFrame:
    """What is wrong now: the errors of each match's last attempt, of each manifest's last reading, and archives still waited for."""
    errors = spark.read.option("basePath", f"{corpus_root}/_errors").parquet(f"{corpus_root}/_errors")
    tried = spark.read.option("basePath", f"{corpus_root}/_attempts").parquet(f"{corpus_root}/_attempts")
    last = tried.groupBy("subject").agg(F.max("batch").alias("batch"))
    subject = F.coalesce("replay_id", _plain("path"))
    return errors.withColumn("subject", subject).join(last, ["subject", "batch"], "left_semi").drop("subject", "batch")


def ingest_batch(corpus_root: str, stream: str, buckets: int | None) -> Callable[[DataFrame, int], None]:
    """Take in what one batch of paths completes; running a batch again changes nothing.

    New manifests join those that wait for an archive. A match whose archives are
    not all there stays in the table of open manifests and is tried again when a
    batch brings an archive of its folder; all others are committed or have errors.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = stage(batch.select(_plain("path").alias("path")), "batch")
        folder = F.regexp_replace("path", "/[^/]*$", "")
        # Only these files are read, not the whole root.
        texts = texts_of(paths.where(F.col("path").endswith("/manifest.json"))).withColumn("manifest_path", _plain("manifest_path"))
        texts = stage(texts, "texts")
        found = parse_manifests(texts)
        waiting = open_manifests(spark, corpus_root, batch_id)
        fresh = found.good if waiting is None else found.good.unionByName(waiting.select(*found.good.columns))
        manifests = stage(latest_manifests(fresh), "manifests")
        own = F.regexp_replace("manifest_path", "/[^/]*$", "").alias("folder")
        touched = paths.select(folder.alias("folder")).distinct()
        due = stage(manifests.select("*", own).join(touched, "folder", "left_semi").drop("folder"), "due")
        columns = ["replay_id", "path", "member", "reason"]
        faults = found.errors.withColumn("replay_id", F.lit(None).cast("string")).select(*columns)
        missing = None
        if not due.isEmpty():
            tables, errors = read_matches(spark, due, None)
            missing = errors.where(F.col("reason") == ARCHIVE_MISSING).select("replay_id").distinct()
            write_tables(tables, corpus_root, buckets=buckets, tag=(stream, batch_id))
            faults = faults.unionByName(errors.select(*columns))
        rest = manifests.join(due.select("replay_id"), "replay_id", "left_anti")
        if missing is not None:
            rest = rest.unionByName(due.join(missing, "replay_id", "left_semi"))
        faults.write.mode("overwrite").parquet(f"{corpus_root}/_errors/batch={batch_id}")
        tried = due.select(F.col("replay_id").alias("subject")).unionByName(texts.select(F.col("manifest_path").alias("subject")))
        tried.distinct().write.mode("overwrite").parquet(f"{corpus_root}/_attempts/batch={batch_id}")
        rest.write.mode("overwrite").parquet(f"{corpus_root}/_open/batch={batch_id}")

    return run


def ingest_stream(
    spark: SparkSession, root: str, corpus_root: str, checkpoint: str, *, per_trigger: int = PER_TRIGGER, buckets: int | None = None
):
    """Keep the corpus up to date with an analysis folder; returns the started query.

    The stream sees manifests and archives as files of their own, so a match is
    taken in when the last of them arrives, in whatever order they come.
    """
    return (
        analysis_stream(spark, root, per_trigger).writeStream
        .foreachBatch(ingest_batch(corpus_root, checkpoint, buckets))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def retry_missing(spark: SparkSession, root: str, corpus_root: str, *, buckets: int | None = None) -> DataFrame:
    """Take in, without a stream, the open manifests whose archives are there by now; returns the errors that remain.

    A running stream does this by itself when the archive arrives.
    """
    waiting = open_manifests(spark, corpus_root)
    if waiting is None:
        return spark.createDataFrame([], "replay_id string, path string, member string, reason string")
    tables, errors = read_matches(spark, waiting, root)
    write_tables(tables, corpus_root, buckets=buckets)
    return errors


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into Parquet files and return."""
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
