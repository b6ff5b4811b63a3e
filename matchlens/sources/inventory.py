"""File listings as tables: catalog, match files, reports, libraries, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, frame_seconds, matchup_text
from ..schema import CATALOG, MANIFEST_VERSION, PLAYER_DOC
from .bundles import expand_archives

SERIES = ("economy.json", "supply.json", "unit_counts.json", "deaths.json")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The unit catalog (name, race, type, times and costs) from CSV."""
    return spark.read.schema(CATALOG).option("header", True).csv(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def match_files(files: DataFrame) -> DataFrame:
    """One row per distinct match file content: id is its hash, the first path wins."""
    chosen = files.where(F.lower("path").endswith(".rep"))
    return chosen.select("path", content_id("content").alias("replay_id")).groupBy("replay_id").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("copies")
    )


def _attribute(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'(?i)(?<![-\w:]){name}\s*=\s*"([^"]*)"', 1)


def script_blocks(pages: DataFrame, css_class: str, *, html: str = "html", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Script blocks of a class: position, attributes text and body."""
    pattern = r"(?is)<script\b([^>]*)>(.*?)</script>"
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)).alias("body"),
    )
    rows = pages.select(*keys, F.posexplode(both).alias("pos", "b")).select(*keys, "pos", F.col("b.attrs").alias("attrs"), F.trim(F.col("b.body")).alias("body"))
    classes = F.split(_attribute(F.col("attrs"), "class"), r"\s+")
    return rows.where(F.array_contains(classes, css_class))


# Block classes of a report that embeds its data.
DATASET, REPLAY, META = "embedded-build-order-dataset", "embedded-build-order-replay", "embedded-build-order-page-meta"


def report_datasets(pages: DataFrame, *, html: str = "html", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Archive members recovered from report pages: (keys, pos, name, member, text)."""
    blocks = script_blocks(pages, DATASET, html=html, keys=keys).select(
        *keys,
        "pos",
        _attribute(F.col("attrs"), "data-name").alias("name"),
        F.expr("try_to_binary(regexp_replace(body, '\\\\s', ''), 'base64')").alias("content"),
    )
    return expand_archives(blocks, [*keys, "pos", "name"])


def report_titles(pages: DataFrame, *, html: str = "html", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    first = script_blocks(pages, META, html=html, keys=keys).groupBy(*keys).agg(F.min_by("body", "pos").alias("body"))
    return first.select(*keys, F.get_json_object("body", "$.title").alias("title"))


def backfill_manifests(archives: DataFrame, replay_ids: DataFrame | None = None) -> DataFrame:
    """Manifests for folders that only have participant archives.

    `archives` is (dir, filename, content). Per owner the archive named after it
    wins, else the first name; duration is the largest frame of any series; the
    id comes from `replay_ids` (dir, replay_id, source_filename) or the folder.
    """
    members = expand_archives(archives.select("dir", "filename", "content"), ["dir", "filename"])
    doc = F.from_json("text", PLAYER_DOC)
    heads = members.where(F.col("member") == "player.json").select("dir", "filename", doc.alias("p")).where(
        F.col("p")["owner"].isNotNull()
    )
    frames = members.where(F.col("member").isin(*SERIES)).select(
        "dir", "filename", F.array_max(F.from_json(F.get_json_object("text", "$.samples[*].frame"), "array<bigint>")).alias("f"),
        F.get_json_object("text", "$.samples[0].frame").cast("bigint").alias("one"),
    ).groupBy("dir", "filename").agg(F.max(F.coalesce("f", "one")).alias("max_frame"))
    own = F.col("filename") == F.concat(F.lit("player_"), F.col("owner").cast("string"), F.lit(".zip"))
    rows = heads.join(frames, ["dir", "filename"], "left").select(
        "dir", "filename", F.col("p")["owner"].alias("owner"), F.col("p")["name"].alias("name"), F.col("p")["race"].alias("race"), "max_frame"
    )
    # An aggregate instead of a ranking: the best archive per (folder, owner).
    best = rows.groupBy("dir", "owner").agg(
        F.min_by(
            F.struct(
                F.coalesce("name", F.concat(F.lit("Player "), (F.col("owner") + 1).cast("string"))).alias("name"),
                F.coalesce("race", F.lit("unknown")).alias("race"),
                F.col("filename").alias("zip_filename"),
                "max_frame",
            ),
            F.struct(F.when(own, 0).otherwise(1).alias("k"), "filename"),
        ).alias("b")
    ).select("dir", "owner", "b.*")
    out = best.groupBy("dir").agg(
        F.array_sort(F.collect_list(F.struct("owner", "name", "race", "zip_filename"))).alias("players"),
        frame_seconds(F.max("max_frame")).alias("duration_seconds"),
    )
    if replay_ids is not None:
        out = out.join(replay_ids, "dir", "left")
    else:
        out = out.withColumn("replay_id", F.lit(None).cast("string")).withColumn("source_filename", F.lit(None).cast("string"))
    return out.select(
        "dir",
        F.lit(MANIFEST_VERSION).alias("schema_version"),
        F.coalesce("replay_id", F.sha2("dir", 256)).alias("replay_id"),
        F.struct(F.col("source_filename").alias("filename"), F.lit(None).cast("string").alias("path")).alias("source"),
        matchup_text("players").alias("matchup"),
        F.lit(None).cast("string").alias("map"),
        "duration_seconds",
        "players",
    )


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def report_artifacts(manifests: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which report belongs to a match, and warnings where that is unclear.

    `manifests` is (manifest_path, replay_id, null when malformed), `listing`
    (path). The report named like its folder wins, else the only one; the first
    manifest of an id in path order counts. Missing reports come from a join
    with the wanted matches by the caller.
    """
    named = manifests.withColumn("dir", _dir(F.col("manifest_path")))
    good = named.where(F.coalesce(F.length("replay_id"), F.lit(0)) > 0)
    firsts = good.groupBy("replay_id").agg(F.min("manifest_path").alias("_first"))
    ranked = good.join(firsts, "replay_id")
    unique = ranked.where(F.col("manifest_path") == F.col("_first"))
    html = listing.where(F.lower("path").endswith(".html")).withColumn("dir", _dir(F.col("path")))
    exact = F.col("path") == F.concat(F.col("dir"), F.lit("/"), _base(F.col("dir")), F.lit(".html"))
    per_dir = html.groupBy("dir").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("any"), F.max(F.when(exact, F.col("path"))).alias("exact")
    )
    found = unique.join(per_dir, "dir", "left").withColumn(
        "html_path", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("any"))
    )
    result = found.where(F.col("html_path").isNotNull()).select("replay_id", "manifest_path", "html_path")
    warn = lambda df, kind, text: df.select(
        F.lit(kind).alias("kind"), "replay_id", "manifest_path", text.alias("message")
    )
    rid = F.coalesce("replay_id", F.lit(""))
    warnings = (
        warn(named.where(F.coalesce(F.length("replay_id"), F.lit(0)) == 0), "invalid_manifest", F.lit("Manifest is missing replay_id"))
        .unionByName(warn(ranked.where(F.col("manifest_path") != F.col("_first")), "duplicate_replay_id", F.concat(F.lit("Duplicate replay_id "), rid)))
        .unionByName(warn(found.where(F.col("html_path").isNull() & (F.col("n") > 1)), "ambiguous_html", F.concat(F.lit("Multiple HTML files found for "), rid)))
    )
    return result, warnings


def missing_artifacts(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Wanted matches without a report."""
    return wanted.join(artifacts.select("replay_id"), "replay_id", "left_anti").select(
        F.lit("missing_html").alias("kind"), "replay_id"
    )


def library(entries: DataFrame, manifests: DataFrame, listing: DataFrame) -> DataFrame:
    """Library entries with warnings, ordered by file name; bad entries stay listed.

    `entries` is (replay_id, filename, manifest_path, report_path) from the
    corpus index, `manifests` the parsed ones, `listing` the existing files.
    """
    m = manifests.select("manifest_path", F.col("replay_id").alias("_id"))
    files = listing.select(F.col("path").alias("report_path"), F.lit(True).alias("_there"))
    w = F.array_compact(
        F.array(
            F.when(F.col("_id").isNull(), F.lit("malformed or missing manifest")),
            F.when(F.col("_id") != F.col("replay_id"), F.lit("manifest replay_id does not match the corpus index")),
            F.when(F.col("_there").isNull(), F.lit("missing report")),
        )
    )
    return (
        entries.join(m, "manifest_path", "left").join(files, "report_path", "left")
        .select("replay_id", "filename", "manifest_path", "report_path", w.alias("warnings"))
        .orderBy("filename", "replay_id")
    )


def archive_names(rows: DataFrame, base: str = "html_name", ident: str = "replay_id") -> DataFrame:
    """Export names that do not collide, ids being unique: `name` for the first id, `id-2-name` for the others."""
    w = Window.partitionBy(base).orderBy(ident)
    n = F.row_number().over(w)
    return rows.withColumn("_n", n).withColumn(
        "zip_path",
        F.concat(
            F.lit("replays/"),
            F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(ident).cast("string"), F.lit("2"), F.col(base))),
        ),
    ).drop("_n")
