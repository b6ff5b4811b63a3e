"""One commit over all tables of a corpus.

Data folders are never changed after they are written: a commit writes its rows
of every table to folders of its own, then notes which older commits hold rows
of the matches it replaces, and last publishes a small snapshot file that names
all commits in force. Publishing is one rename that never overwrites, so readers
see all tables of a commit or none, a failure on the way leaves the old snapshot
as it was, and of two writers at once the second starts again from the first
one's snapshot. What a commit writes is in proportion to what comes in, however
large the corpus is.

Readers take the folders in force and leave out replaced matches by an anti join
with the notes, which exist only for matches that were taken in again. `compact`
joins small commits; `remove_unused` deletes folders no kept snapshot names.

    root/_snapshots/00000007.json   {"version", "commits", "replaced_by", "tags"}
    root/<table>/commit=<name>/...  rows of one commit
    root/_replaced/commit=<name>/   (replay_id, replaced): rows of `replaced` no longer hold

The file system must have a rename that fails where the target exists, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..schema import SCHEMA_VERSION, TABLES, Corpus, column_names
from .staging import stage

FOLDER = "_snapshots"
REPLACED = "_replaced"
KEY = "replay_id"
FACTS = tuple(t for t in TABLES if t != "schema_metadata")
# Order of columns that lets Parquet statistics prune.
SORT = {
    "build_order_events": ["replay_id", "owner", "item_lc", "time_seconds"],
    "unit_count_samples": ["replay_id", "owner", "unit_type_lc", "time_seconds"],
}


class Conflict(Exception):
    """Another writer published the next snapshot first."""


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    commits: tuple[str, ...] = ()
    replaced_by: tuple[str, ...] = ()  # commits that have notes on replaced rows
    tags: dict[str, int] = field(default_factory=dict)  # greatest batch of each stream

    def to_json(self) -> str:
        return json.dumps({
            "schema_version": SCHEMA_VERSION, "version": self.version, "commits": self.commits, "replaced_by": self.replaced_by, "tags": self.tags})


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published snapshots, ascending."""
    fs, folder = _fs(spark, f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or that of a version; an empty one where nothing was published yet."""
    found = versions(spark, root)
    if version is not None and version not in found:
        raise ValueError(f"corpus at {root} has no snapshot {version}")
    if not found:
        return Snapshot()
    text = spark.read.option("wholetext", True).text(f"{root}/{FOLDER}/{found[-1] if version is None else version:08d}.json").first()[0]
    doc = json.loads(text)
    return Snapshot(doc["version"], tuple(doc["commits"]), tuple(doc["replaced_by"]), doc["tags"])


def publish(spark: SparkSession, root: str, new: Snapshot) -> None:
    """Make `new` the newest snapshot, or raise `Conflict`."""
    fs, folder = _fs(spark, f"{root}/{FOLDER}")
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, target = path(folder, f"_{uuid.uuid4().hex}"), path(folder, f"{new.version:08d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(new.to_json().encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, none)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"snapshot {new.version} of {root} is taken") from error
        raise


def _rows(spark: SparkSession, root: str, table: str, of: Snapshot, layout: str | None = None) -> DataFrame:
    """Rows in force of one table, with the commit they come from."""
    schema = f"{layout or TABLES[table]}, commit string"
    if not of.commits:
        return spark.createDataFrame([], schema)
    folders = [f"{root}/{table}/commit={c}" for c in of.commits]
    rows = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*folders)
    notes = _notes(spark, root, of)
    return rows if notes is None else rows.join(notes, [KEY, "commit"], "left_anti").select(*rows.columns)


def _notes(spark: SparkSession, root: str, of: Snapshot) -> DataFrame | None:
    if not of.replaced_by:
        return None
    folders = [f"{root}/{REPLACED}/commit={c}" for c in of.replaced_by]
    return spark.read.schema(f"{KEY} string, replaced string").parquet(*folders).select(KEY, F.col("replaced").alias("commit"))


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    return _rows(spark, root, table, snapshot(spark, root, version)).select(*column_names(TABLES[table]))


def open_snapshot(spark: SparkSession, root: str, version: int | None = None, catalog: DataFrame | None = None) -> Corpus:
    """All tables of one snapshot; later commits do not change what is read."""
    of = snapshot(spark, root, version)
    if not of.version:
        raise ValueError(f"corpus at {root} has no snapshot")
    return Corpus(**{t: _rows(spark, root, t, of).select(*column_names(TABLES[t])) for t in FACTS}, catalog=catalog)


def _publish_on(spark: SparkSession, root: str, build: Callable[[Snapshot], Snapshot], attempts: int) -> Snapshot:
    """Publish what `build` makes of the newest snapshot; where another writer was first, of the one after it."""
    for left in reversed(range(attempts)):
        new = build(snapshot(spark, root))
        try:
            publish(spark, root, new)
        except Conflict:
            if not left:
                raise
            continue
        return new
    raise ValueError("attempts must be positive")


def commit(
    tables: dict[str, DataFrame], root: str, *, tag: tuple[str, int] | None = None, ids: DataFrame | None = None, parts: int | None = None, attempts: int = 5
) -> Snapshot:
    """Replace the matches of `ids` (those of `replays`, where not given) in all tables at once.

    A match of `ids` without new rows is removed. With a `tag` (stream, batch) a
    batch that is in force already is not written again. `parts` is how many
    partitions rows of small sources are dealt to before AQE joins small and
    splits large ones. Rows of large sources are written in the partitions they
    come in, which Spark has already sized; to deal them again would shuffle the
    whole commit once more.
    """
    spark = next(iter(tables.values())).sparkSession
    missing = set(FACTS) - set(tables)
    if missing:
        raise ValueError(f"commit lacks tables: {', '.join(sorted(missing))}")
    now = snapshot(spark, root)
    if tag is not None and now.tags.get(tag[0], -1) >= tag[1]:
        return now
    name = uuid.uuid4().hex
    ids = stage((tables["replays"] if ids is None else ids).select(F.col(KEY).cast("string")).distinct(), "ids")
    for table in FACTS:
        rows = tables[table].select(*column_names(TABLES[table]))
        if ordered.is_small(rows):
            rows = rows.hint("rebalance") if parts is None else rows.hint("rebalance", parts)
        rows.sortWithinPartitions(*SORT.get(table, [KEY])).write.parquet(f"{root}/{table}/commit={name}")
    seen: list[Snapshot] = []

    def build(of: Snapshot) -> Snapshot:
        held = _rows(spark, root, "replays", of, f"{KEY} string").join(ids, KEY, "left_semi")
        note = f"{name}-{len(seen)}"
        seen.append(of)
        old = held.select(KEY, F.col("commit").alias("replaced")).distinct()
        old.write.parquet(f"{root}/{REPLACED}/commit={note}")
        noted = not spark.read.schema(f"{KEY} string, replaced string").parquet(f"{root}/{REPLACED}/commit={note}").isEmpty()
        tags = of.tags if tag is None else {**of.tags, tag[0]: tag[1]}
        return Snapshot(of.version + 1, (*of.commits, name), (*of.replaced_by, note) if noted else of.replaced_by, tags)

    return _publish_on(spark, root, build, attempts)


def _size(spark: SparkSession, root: str, name: str) -> int:
    total = 0
    for table in FACTS:
        fs, folder = _fs(spark, f"{root}/{table}/commit={name}")
        total += fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0
    return total


def compact(spark: SparkSession, root: str, below_bytes: int = 1 << 30) -> Snapshot:
    """Join all commits smaller than `below_bytes` into one, without their replaced rows.

    Rows of larger commits are not touched; notes on them stay. A commit that
    comes in between makes this start again from its snapshot.
    """

    def build(of: Snapshot) -> Snapshot:
        small = [c for c in of.commits if _size(spark, root, c) < below_bytes]
        if len(small) < 2:
            return Snapshot(of.version + 1, of.commits, of.replaced_by, of.tags)
        name = uuid.uuid4().hex
        for table in FACTS:
            rows = _rows(spark, root, table, of).where(F.col("commit").isin(*small)).select(*column_names(TABLES[table])).hint("rebalance")
            rows.sortWithinPartitions(*SORT.get(table, [KEY])).write.parquet(f"{root}/{table}/commit={name}")
        notes, left = _notes(spark, root, of), ()
        if notes is not None:
            kept = notes.where(~F.col("commit").isin(*small)).select(KEY, F.col("commit").alias("replaced"))
            kept.write.parquet(f"{root}/{REPLACED}/commit={name}")
            left = (name,)
        return Snapshot(of.version + 1, (*[c for c in of.commits if c not in small], name), left, of.tags)

    return _publish_on(spark, root, build, attempts=3)


def remove_unused(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that none of the last `keep` snapshots names; to be run when nobody writes. Returns what was deleted."""
    numbers = versions(spark, root)
    kept = [snapshot(spark, root, v) for v in numbers[-keep:]]
    named = {t: {c for s in kept for c in s.commits} for t in FACTS} | {REPLACED: {c for s in kept for c in s.replaced_by}}
    gone = []
    for table, names in named.items():
        fs, folder = _fs(spark, f"{root}/{table}")
        if not fs.exists(folder):
            continue
        for f in fs.listStatus(folder):
            name = f.getPath().getName()
            if name.startswith("commit=") and name.removeprefix("commit=") not in names:
                fs.delete(f.getPath(), True)
                gone.append(f"{table}/{name}")
    for v in numbers[:-keep]:
        fs, path = _fs(spark, f"{root}/{FOLDER}/{v:08d}.json")
        fs.delete(path, False)
    return gone
