"""Analysis output as a source: manifests, participant archives, typed series.

Nothing aborts the read. Whatever is wrong is a row (path, member, reason) in
the error table, and a match with any error contributes no rows.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (
    COUNTS_DOC,
    DEATHS_DOC,
    ECONOMY_DOC,
    MANIFEST,
    MANIFEST_VERSION,
    PLAYER_DOC,
    SUPPLY_DOC,
    with_folded,
)
from . import files
from .staging import BATCH_BYTES, bounded_batches, stage

REQUIRED = ("player.json", "build_order.txt", "economy.json", "supply.json")
OPTIONAL = ("unit_counts.json", "deaths.json")
CORRUPT = "_corrupt_record"
ARCHIVE_MISSING = "archive not found"
# A line: the clock, then supply in brackets where it is given, then the item, all on one line ("." stops at line breaks).
LINE = r"\A\s*([0-9]+):([0-5][0-9])\s+(?:\[([0-9]+)/([0-9]+)\][ \t\x0B\f]+)?([^\s\x85\x{2028}\x{2029}](?:.*[^\s\x85\x{2028}\x{2029}])?)\s*\z"
CUT = "\u0001"


@dataclass
class Manifests:
    good: DataFrame
    errors: DataFrame


@dataclass
class Bundles:
    """Members of the wanted archives plus what was wrong with any of them."""

    members: DataFrame  # replay_id, owner, zip_path, member, text
    players: DataFrame
    errors: DataFrame


def _error(df: DataFrame, path, member, reason) -> DataFrame:
    return df.select(path.alias("path"), member.alias("member"), reason.alias("reason"))


def manifest_texts(spark: SparkSession, root: str) -> DataFrame:
    """(manifest_path, text) of every file named exactly manifest.json below root."""
    folders = files.roots(spark, root)
    if files.reachable(folders, FileType.Directory):
        return stage(texts_of(files.below(spark, folders, "manifest.json")), "texts")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "manifest.json")
        .option("wholetext", True)
        .text(root)
        .select(F.col("_metadata.file_path").alias("manifest_path"), F.col("value").alias("text"))
    )


def texts_of(paths: DataFrame) -> DataFrame:
    """(manifest_path, text) of manifests given by `path`; only these files are read."""
    spark = paths.sparkSession
    first = paths.first()
    if first is None:
        return spark.createDataFrame([], "manifest_path string, text string")
    if files.reachable([first.path], FileType.File):
        uri = F.udf(lambda path: files.as_uri(path), "string")
        held = files.contents(paths.select("path"), needed=True)
        return held.select(uri("path").alias("manifest_path"), F.col("content").cast("string").alias("text"))
    # Spark's reader takes their names from the driver.
    named = [r.path for r in paths.select("path").collect()]
    return spark.read.option("wholetext", True).text(named).select(F.col("_metadata.file_path").alias("manifest_path"), F.col("value").alias("text"))


def parse_manifests(texts: DataFrame) -> Manifests:
    """Typed manifests, and the reasons for those that are not usable."""
    doc = F.from_json("text", f"{MANIFEST}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = texts.select("manifest_path", doc.alias("d"))
    d = F.col("d")
    nameless = F.exists(d["players"], lambda p: F.coalesce(F.length(p["zip_filename"]), F.lit(0)) == 0)
    reason = (
        F.when(d.isNull() | d[CORRUPT].isNotNull(), "malformed manifest")
        .when(~d["schema_version"].eqNullSafe(F.lit(MANIFEST_VERSION)), F.concat(F.lit("unsupported manifest schema "), F.coalesce(d["schema_version"], F.lit("null"))))
        .when(F.coalesce(F.length(d["replay_id"]), F.lit(0)) == 0, "manifest is missing replay_id")
        .when(d["players"].isNull(), "manifest players must be an array")
        .when(nameless, "manifest player is missing zip_filename")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(
        d["replay_id"].alias("replay_id"),
        d["source"]["filename"].alias("source_replay_filename"),
        d["source"]["path"].alias("source_replay_path"),
        d["matchup"].alias("matchup"),
        d["map"].alias("map"),
        d["duration_seconds"].alias("duration_seconds"),
        "manifest_path",
        d["players"].alias("players"),
    )
    errors = _error(judged.where(F.col("reason").isNotNull()), F.col("manifest_path"), F.lit("manifest.json"), F.col("reason"))
    return Manifests(good, errors)


def read_manifests(spark: SparkSession, root: str) -> Manifests:
    return parse_manifests(manifest_texts(spark, root))


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """One manifest per match id: the last in path order."""
    cols = [c for c in manifests.columns if c != "replay_id"]
    return manifests.groupBy("replay_id").agg(F.max_by(F.struct(*cols), "manifest_path").alias("m")).select("replay_id", "m.*")


def expand_archives(archives: DataFrame, keys: list[str], only: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (keys, member, text, problem) of zip archives in a `content` column; of the members in `only`, where given.

    Archives are opened inside the scan's tasks, one at a time, and members are
    handed on before they add up to more than a batch and one archive.
    """
    bounded_batches(archives.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in archives.schema.fields}
    ddl = ", ".join(f"{k} {fields[k]}" for k in keys) + ", member string, text string, problem string"
    names = [*keys, "member", "text", "problem"]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for rec in pdf.to_dict("records"):
                base = [rec[k] for k in keys]
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(rec["content"])) as archive:
                        for info in archive.infolist():
                            if not info.is_dir() and (only is None or info.filename in only):
                                out.append((*base, info.filename, archive.read(info).decode("utf-8", "replace"), None))
                except (zipfile.BadZipFile, TypeError, OSError, RuntimeError, NotImplementedError) as error:
                    out = [(*base, None, None, f"unreadable archive: {error}")]
                rows += out
                size += sum(len(row[-2] or "") for row in out)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return archives.select(*keys, "content").mapInPandas(expand, ddl)


def manifest_folder() -> Column:
    return F.regexp_replace("manifest_path", "/[^/]*$", "")


def wanted_archives(manifests: DataFrame, *more: str) -> DataFrame:
    """(replay_id, owner, name, race, zip_path): the archives manifests point at; `folder` too, if asked for."""
    p = F.col("p")
    folder = manifest_folder()
    return manifests.select("replay_id", "manifest_path", F.explode("players").alias("p")).select(
        "replay_id",
        p["owner"].alias("owner"),
        p["name"].alias("name"),
        p["race"].alias("race"),
        F.concat_ws("/", folder, p["zip_filename"]).alias("zip_path"),
        *[folder.alias(m) for m in more],
    )


def _plain(path: Column | str) -> Column:
    """File sources report file:/x or file:///x."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def open_archives(spark: SparkSession, manifests: DataFrame, root: str | None) -> tuple[DataFrame, DataFrame]:
    """The known members of exactly the archives named by the manifests, and the
    archives wanted; other archives are never opened. An archive lies below `root`,
    or where that is None below its manifest's folder."""
    wanted = wanted_archives(manifests).withColumn("zip_path", _plain("zip_path"))
    if root is not None:
        folders, kind = files.roots(spark, root), FileType.Directory
    else:
        folders, kind = [r.manifest_path for r in manifests.select("manifest_path").take(1)], None
    if files.reachable(folders, kind):
        # By path, so that no listing of all files goes to the driver.
        own = wanted_archives(manifests, "folder").withColumns({"zip_path": _plain("zip_path"), "folder": _plain("folder")})
        inside = files.visible(F.col("zip_path"), F.col("folder")) if root is None else functools.reduce(
            Column.__or__, [files.visible(F.col("zip_path"), _plain(F.lit(f))) for f in folders])
        named = own.where(inside & F.col("zip_path").endswith(".zip")).select("replay_id", "owner", "zip_path")
        return expand_archives(files.contents(named, "zip_path"), ["replay_id", "owner", "zip_path"], (*REQUIRED, *OPTIONAL)), wanted
    within = [r[0] for r in manifests.select(manifest_folder()).distinct().collect()] if root is None else root
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(within)
        .select(F.col("path").alias("zip_path"), "content")
    )
    found = listed.withColumn("zip_path", _plain("zip_path")).join(wanted, "zip_path")
    return expand_archives(found, ["replay_id", "owner", "zip_path"], (*REQUIRED, *OPTIONAL)), wanted


def read_bundles(spark: SparkSession, manifests: DataFrame, root: str | None) -> Bundles:
    """Members of the archives named by the manifests. A missing archive, member
    or owner match is an error row."""
    return judge_bundles(*open_archives(spark, manifests, root))


def judge_bundles(expanded: DataFrame, wanted: DataFrame) -> Bundles:
    """Check archive members against the manifests."""
    key = ["replay_id", "owner", "zip_path"]
    have = expanded.groupBy(*key).agg(
        F.collect_set(F.when(F.col("member").isin(*REQUIRED), F.col("member"))).alias("have"), F.max("problem").alias("problem")
    )
    doc = F.from_json("text", PLAYER_DOC)
    bundle_owner = expanded.where(F.col("member") == "player.json").groupBy(*key).agg(F.max(doc["owner"]).alias("bundle_owner"))
    judged = wanted.join(have, key, "left").join(bundle_owner, key, "left")
    lacking = F.array_except(F.array(*[F.lit(m) for m in REQUIRED]), F.coalesce("have", F.array().cast("array<string>")))
    reason = (
        F.when(F.col("have").isNull(), F.lit(ARCHIVE_MISSING))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing required bundle file "), F.array_join(lacking, ", ")))
        .when(F.col("bundle_owner").isNull(), F.lit("invalid JSON in player.json"))
        .when(
            F.col("bundle_owner") != F.col("owner"),
            F.concat(F.lit("player.json owner "), F.col("bundle_owner").cast("string"), F.lit(" does not match manifest owner "), F.col("owner").cast("string")),
        )
    )
    bad = judged.withColumn("reason", reason).where(F.col("reason").isNotNull())
    errors = bad.select("replay_id", F.col("zip_path").alias("path"), F.lit(None).cast("string").alias("member"), "reason")
    return Bundles(expanded.where(F.col("member").isNotNull()).drop("problem"), wanted, errors)


def parse_lines(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build-order lines as events, and the lines that do not parse."""
    lines = members.where(F.col("member") == "build_order.txt").select(
        "replay_id", "owner", "zip_path", F.posexplode(F.split("text", "\r?\n")).alias("event_seq", "raw_line")
    ).where(F.trim(F.regexp_replace("raw_line", r"\s", " ")) != "")
    return parse_line_rows(lines)


def parse_line_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pattern judges a line, and the same pattern cuts it, once: its parts are bound as a lambda's argument."""
    fits = F.col("raw_line").rlike(LINE)
    parts = F.split(F.regexp_replace("raw_line", LINE, CUT.join(f"${i}" for i in range(1, 6))), CUT, 5)

    def typed(w: Column) -> Column:
        number = lambda i: F.when(w[i] != "", w[i].cast("int"))
        return F.struct(
            (w[0].cast("bigint") * 60 + w[1].cast("int")).cast("double").alias("time_seconds"),
            number(2).alias("supply_used"), number(3).alias("supply_max"), w[4].alias("item"))

    good = lines.where(fits).select(
        "replay_id", "owner", "raw_line", F.col("event_seq").cast("bigint").alias("event_seq"), F.inline(F.transform(F.array(parts), typed))
    ).select("replay_id", "owner", "time_seconds", "supply_used", "supply_max", "item", "raw_line", "event_seq")
    bad = lines.where(~fits).select(
        "replay_id", F.col("zip_path").alias("path"), F.lit("build_order.txt").alias("member"),
        F.concat(F.lit("invalid line: "), "raw_line").alias("reason"),
    )
    return with_folded(good, "build_order_events"), bad


def _docs(members: DataFrame, member: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    doc = F.from_json("text", f"{ddl}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = members.where(F.col("member") == member).select("replay_id", "owner", "zip_path", doc.alias("d"))
    broken = F.col("d").isNull() | F.col("d")[CORRUPT].isNotNull()
    bad = rows.where(broken).select(
        "replay_id", F.col("zip_path").alias("path"), F.lit(member).alias("member"), F.lit(f"invalid JSON in {member}").alias("reason")
    )
    return rows.where(~broken).select("replay_id", "owner", F.inline("d.samples")), bad


def read_series(bundles: Bundles, manifests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The corpus tables of all faultless matches, and every error found."""
    tables, errors = parse_series(bundles, manifests)
    return faultless(tables, errors), errors


def read_matches(spark: SparkSession, manifests: DataFrame, root: str | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """`read_series` of the archives under a folder (None: under their manifests' own), for writing.

    Manifests, members and errors are each written once to the shared folder, so
    every archive is opened once and judged once, however many tables follow. A
    table reads the folder of its member alone.
    """
    manifests = stage(manifests, "manifests")
    members, wanted = open_archives(spark, manifests, root)
    tables, errors = parse_series(judge_bundles(stage(members, "members", ["member"]), wanted), manifests)
    errors = stage(errors, "errors")
    return faultless(tables, errors), errors


def faultless(tables: dict[str, DataFrame], errors: DataFrame) -> dict[str, DataFrame]:
    """The tables without matches that have an error."""
    spoiled = errors.select("replay_id").distinct()
    return {n: df.join(spoiled, "replay_id", "left_anti") for n, df in tables.items()}


def parse_series(bundles: Bundles, manifests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The corpus tables of all matches, faulty ones included, and every error found."""
    m = bundles.members
    events, bad_lines = parse_lines(m)
    economy, e1 = _docs(m, "economy.json", ECONOMY_DOC)
    supply, e2 = _docs(m, "supply.json", SUPPLY_DOC)
    counts, e3 = _docs(m, "unit_counts.json", COUNTS_DOC)
    deaths, e4 = _docs(m, "deaths.json", DEATHS_DOC)
    errors = bundles.errors
    for e in (bad_lines, e1, e2, e3, e4):
        errors = errors.unionByName(e)
    k = ["replay_id", "owner"]
    frame = F.col("frame").cast("bigint").alias("frame")
    tables = {
        "replays": manifests.drop("players"),
        "players": with_folded(bundles.players, "players"),
        "build_order_events": events,
        "economy_samples": economy.select(
            *k, "time_seconds", "minerals", "gas", "gathered_minerals", "gathered_gas", "workers", frame
        ),
        "supply_samples": supply.select(*k, "time_seconds", "current", "max", frame),
        "unit_count_samples": with_folded(
            counts.select(*k, "time_seconds", F.explode("counts").alias("unit_type", "count"), frame), "unit_count_samples"
        ),
        "death_events": deaths.select(
            *k, frame, "time_seconds", F.col("death")["owner"].alias("dead_owner"),
            F.col("death")["unit_type"].alias("unit_type"), F.col("death")["category"].alias("category"),
        ),
    }
    return tables, errors
