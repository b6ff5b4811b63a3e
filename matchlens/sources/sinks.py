"""Writing: keyed replacement, bundles, manifests, indexes, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import frame_seconds, matchup_text, padded_clock
from ..operators.ordered import MAX_ROWS, ordered_scan, text_place
from ..schema import MANIFEST_VERSION, SCHEMA_VERSION
from .bundles import latest_manifests, read_manifests, read_matches
from .snapshots import commit

BUCKET = "replay_bucket"
BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def replace_matches(
    incoming: DataFrame, path: str, ids: DataFrame, *, key: str = "replay_id", buckets: int = BUCKETS, sort: Sequence[str] = ()
) -> None:
    """Replace all rows of the given ids in a bucketed Parquet table.

    Only buckets that hold an incoming id are read and rewritten, by dynamic
    partition overwrite, so the call can be repeated. A bucket left without rows
    is not overwritten by Spark; its old files are removed afterwards. The write
    is rebalanced: AQE splits a bucket that one match fills and joins small ones.
    """
    spark = incoming.sparkSession
    new = incoming.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    touched = ids.select(key).distinct().withColumn(BUCKET, bucket_of(F.col(key), buckets))
    before: dict[str, list] = {}
    if _exists(spark, path):
        # At most `buckets` numbers.
        numbers = sorted(r[0] for r in touched.select(BUCKET).distinct().collect())
        before = {f"{path}/{BUCKET}={n}": _files(spark, f"{path}/{BUCKET}={n}") for n in numbers}
        old = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(*numbers))
        kept = old.join(touched.select(key), key, "left_anti")
        out = new.unionByName(kept.select(*new.columns))
    else:
        out = new
    out = out.hint("rebalance", BUCKET)
    by = list(sort) or [key]
    (
        out.sortWithinPartitions(BUCKET, *[c for c in by if c in out.columns])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    )
    for folder, files in before.items():
        for name in set(files) & set(_files(spark, folder)):
            target = spark._jvm.org.apache.hadoop.fs.Path(name)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the data files in one folder; empty when it does not exist."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath().toString()) for f in fs.listStatus(target)] if fs.exists(target) else []


def batch_report(manifests: DataFrame, batch_size: int = 10) -> DataFrame:
    """Manifests per batch in path order, with what is done and left after each."""
    if batch_size < 1:
        raise ValueError("batch size must be positive")
    rows = text_place(manifests.select("manifest_path", "replay_id"), "manifest_path").withColumn("_all", F.lit(0))
    # All rows are of one key, so they are counted however few bytes they have.
    placed = ordered_scan(rows, ["_all"], ["_place", "manifest_path"], {"rn": ("total", F.lit(1).cast("bigint"))}, max_rows=MAX_ROWS)
    per = placed.groupBy(F.ceil(F.col("rn") / batch_size).alias("batch_number")).agg(
        F.count(F.lit(1)).alias("manifest_count"),
        F.array_sort(F.collect_list(F.struct("rn", "replay_id")))["replay_id"].alias("replay_ids"),
        F.max("rn").alias("manifests_completed"),
        F.lit(0).alias("_one"),
    )
    total = placed.agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_one"))
    # One row.
    return per.join(F.broadcast(total), "_one").select(
        "batch_number", "manifest_count", "replay_ids", "manifests_completed",
        (F.col("_n") - F.col("manifests_completed")).alias("manifests_remaining"),
    )


def ingest(spark: SparkSession, analysis_root: str, corpus_root: str, *, batch_size: int = 10, buckets: int | None = None) -> dict[str, DataFrame]:
    """Read all analyses below a folder and replace their matches in the corpus, in one commit.

    Returns the batch report and the errors; matches with errors are left out.
    Every archive is opened once for all tables.
    """
    found = read_manifests(spark, analysis_root)
    manifests = latest_manifests(found.good)
    tables, errors = read_matches(spark, manifests, analysis_root)
    write_tables(tables, corpus_root, buckets=buckets)
    faults = found.errors.withColumn("replay_id", F.lit(None).cast("string")).unionByName(errors)
    return {"batches": batch_report(found.good, batch_size), "errors": faults}


def write_tables(tables: dict[str, DataFrame], corpus_root: str, *, buckets: int | None = None, tag: tuple[str, int] | None = None) -> None:
    """Replace the incoming matches in every corpus table, all tables in one commit."""
    commit(tables, corpus_root, tag=tag, parts=buckets)
    spark = tables["replays"].sparkSession
    if not _exists(spark, f"{corpus_root}/schema_metadata"):
        meta = spark.range(1).select(F.lit("schema_version").alias("key"), F.lit(SCHEMA_VERSION).alias("value"))
        meta.write.mode("overwrite").parquet(f"{corpus_root}/schema_metadata")


def series_documents(samples: DataFrame, keys: Sequence[str], fields: Sequence[str], schema_version: str, slice_seconds: float | None = None) -> DataFrame:
    """JSON documents per participant with the samples in time order; `part` numbers them.

    One document holds a whole series (part 0). With `slice_seconds` a document
    covers at most that much time, for series too long to be held as one value.
    """
    keys = list(keys)
    at = (F.lit(0).cast("bigint") if slice_seconds is None else F.floor(F.col("time_seconds") / slice_seconds)).alias("part")
    rows = samples.select(*keys, at, F.struct(*fields).alias("s"))
    first = fields[0]
    in_order = lambda a, b: F.when(a[first] < b[first], -1).when(a[first] > b[first], 1).otherwise(0)
    docs = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("s"), in_order).alias("samples"))
    return docs.select(*keys, "part", F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), "samples")).alias("json"))


def write_bundles(series: dict[str, DataFrame], path: str, slice_seconds: float | None = None) -> None:
    """The series of every participant as JSON documents, a folder per kind."""
    layout = {
        "economy": (["frame", "time_seconds", "minerals", "gas", "gathered_minerals", "gathered_gas", "workers"], "replay-analysis-economy-v1"),
        "supply": (["frame", "time_seconds", "current", "max"], "replay-analysis-supply-v1"),
        "unit_counts": (["frame", "time_seconds", "counts"], "replay-analysis-unit-counts-v1"),
        "deaths": (["frame", "time_seconds", "death"], "replay-analysis-deaths-v1"),
    }
    for name, (fields, version) in layout.items():
        df = series[name]
        if name == "deaths" and "death" not in df.columns:
            df = df.withColumn(
                "death",
                F.struct(F.col("unit_id").alias("id"), F.col("dead_owner").alias("owner"), "unit_type", "unit_type_id", "category", "pos_x", "pos_y"),
            )
        docs = series_documents(df, ["replay_id", "owner"], [f for f in fields if f in df.columns], version, slice_seconds)
        docs.write.mode("overwrite").json(f"{path}/{name}")
    build_order_lines(series["events"]).write.mode("overwrite").json(f"{path}/build_order")


def build_order_lines(events: DataFrame) -> DataFrame:
    """`MM:SS Item` lines, equal (frame, owner, item) collapsed."""
    rows = events.dropDuplicates(["replay_id", "owner", "frame", "item"])
    return rows.select(
        "replay_id", "owner", "frame", "item", F.concat_ws(" ", padded_clock(frame_seconds("frame")), "item").alias("line")
    )


def match_manifests(people: DataFrame, last_frames: DataFrame, sources: DataFrame) -> DataFrame:
    """Manifest documents: participants in owner order, duration from the last frame.

    `people` is (replay_id, owner, name, race), `last_frames` (replay_id,
    last_frame), `sources` (replay_id, filename, path).
    """
    players = people.groupBy("replay_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "owner",
                    F.coalesce("name", F.concat(F.lit("Player "), (F.col("owner") + 1).cast("string"))).alias("name"),
                    F.coalesce("race", F.lit("unknown")).alias("race"),
                    F.concat(F.lit("player_"), F.col("owner").cast("string"), F.lit(".zip")).alias("zip_filename"),
                )
            )
        ).alias("players")
    )
    rows = sources.join(last_frames, "replay_id", "left").join(players, "replay_id", "left")
    doc = F.struct(
        F.lit(MANIFEST_VERSION).alias("schema_version"),
        F.col("replay_id").cast("string").alias("replay_id"),
        F.struct("filename", "path").alias("source"),
        matchup_text("players").alias("matchup"),
        F.lit(None).cast("string").alias("map"),
        frame_seconds("last_frame").alias("duration_seconds"),
        "players",
    )
    return rows.select("replay_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def corpus_index(manifests: DataFrame) -> DataFrame:
    """Index rows of the corpus, sorted by match id; written as JSON lines."""
    return manifests.select(
        "replay_id", "source_replay_filename", "matchup", "duration_seconds", "manifest_path"
    ).orderBy("replay_id")


def event_cells(value: Column, name: str) -> list[Column]:
    return [value["time_seconds"].alias(f"{name}_time_seconds"), padded_clock(value["time_seconds"]).alias(f"{name}_time_clock")]


def export_rows(result: DataFrame, columns: dict[str, Sequence[str]], *, artifacts: DataFrame | None = None) -> DataFrame:
    """Flat export of a pattern search.

    `columns` maps an output to the result columns to take it from, best first:
    an evidence value, else the value of a matching constraint. Struct values
    give their leaves with the output's name in front.
    """
    out = result if artifacts is None else result.join(artifacts.select("replay_id", F.col("html_path").alias("relative_html_path")), "replay_id", "left")
    cells: list[Column] = []
    for name, sources in columns.items():
        present = [s for s in sources if s.split(".")[0] in result.columns]
        value = F.coalesce(*[F.col(s) for s in present]) if present else F.lit(None).cast("string")
        cells.append(value.alias(name))
    fixed = ["replay_id", "source_replay_filename", "matchup", "self_player_name", "enemy_player_name"]
    tail = ["relative_html_path"] if artifacts is not None else []
    return out.select(*fixed, *cells, *tail)


def write_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls as empty cells; maps and structs as JSON."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("map", "struct", "array")}
    flat = rows.select(
        *[
            F.coalesce((F.to_json(F.col(c)) if c in nested else F.col(c).cast("string")), F.lit("")).alias(c)
            for c in rows.columns
        ]
    )
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
