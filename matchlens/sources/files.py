"""Files of a folder, listed and read by tasks.

Spark's file sources list on the driver, which gets and holds the status of every
file below a root, also of those that are not wanted. Here tasks list the folders,
level by level, and open files by path, so the driver sees no more than counts.

Tasks open files with pyarrow's file systems. Where those don't reach a store,
as with viewfs, `reachable` says so and callers take Spark's sources.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import BATCH_BYTES, bounded_batches, stage

#: Folders or files of one task.
PER_TASK = 1_000
#: Rows of a listing handed on at a time.
ROWS = 10_000
#: Names that Spark's sources pass over, in a path below a root; empty names and dots too.
HIDDEN = r"(^|/)(\.|/|$|_(?!metadata|common_metadata)[^/=]*(/|$)|[^/]*\._COPYING_(/|$))"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def few_listing_tasks(spark: SparkSession) -> None:
    """Lower the session's tasks for one listing by Spark's own sources to four a core; a lower setting stays.

    Spark takes a task for each path, up to 10,000: the driver's work on them is all the time such a listing takes.
    """
    few = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(LISTING_TASKS)) > few:
        spark.conf.set(LISTING_TASKS, str(few))


@functools.lru_cache
def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Hadoop writes it (unescaped), and the place there."""
    if path.startswith(("file:/", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    store, rest = re.match("([^:/]+://[^/]*)/*(.*)", path, re.S).groups()
    system, base = _store(f"{store}/")
    return system, f"{base.rstrip('/')}/{rest}"


def roots(spark: SparkSession, root: str) -> list[str]:
    """The folders a root stands for (it may be a glob), with their scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def reachable(paths: list[str], kind: fs.FileType | None = None) -> bool:
    """Whether tasks can open the store of all these paths, and they are folders or files, where `kind` says so; not if there are none."""
    try:
        kinds = [system.get_file_info(place).type for system, place in map(_opened, paths)]
    except (OSError, ValueError, NotImplementedError):
        return False
    return bool(kinds) and (kind is None or set(kinds) == {kind})


def _dealt(paths: DataFrame, n: int) -> DataFrame:
    """Paths over a task for every `PER_TASK`, and over all cores."""
    return paths.repartition(max(1, -(-n // PER_TASK), min(n, paths.sparkSession.sparkContext.defaultParallelism)))


def below(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """`path` of the files of a name at any depth below some folders; hidden and empty ones are passed over."""
    hidden = re.compile(HIDDEN)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in batches:
            for path in pdf["path"]:
                system, place = _opened(path)
                for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                    folder = f.type == fs.FileType.Directory
                    if (folder or f.base_name == name and f.size) and not hidden.search(f.base_name):
                        rows.append((f"{path.rstrip('/')}/{f.base_name}", folder))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=["path", "folder"])
                        rows = []
        yield pd.DataFrame(rows, columns=["path", "folder"]).astype({"folder": bool})

    level, n, found = spark.createDataFrame([(f,) for f in folders], "path string"), len(folders), []
    while n:
        rows = stage(_dealt(level, n).mapInPandas(listed, "path string, folder boolean"), "listing")
        found.append(rows.where("not folder").select("path"))
        level = rows.where("folder").select("path")
        n = level.count()
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string")


def visible(path: Column, root: str | Column) -> Column:
    """Whether a path lies below a root, by names that Spark's sources would not pass over."""
    start = F.concat(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    return path.startswith(start) & ~F.substr(path, F.length(start) + 1).rlike(HIDDEN)


def contents(paths: DataFrame, path: str = "path", needed: bool = False) -> DataFrame:
    """`paths` with `content`, in batches bounded in bytes; what is no file, or an empty one, has no row (an error if `needed` and not there)."""
    spark = paths.sparkSession
    bounded_batches(spark)
    columns = paths.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for rec in pdf.itertuples(index=False, name=None):
                system, place = _opened(rec[columns.index(path)])
                info = system.get_file_info(place)
                if info.type == fs.FileType.NotFound and needed:
                    raise FileNotFoundError(place)
                if info.type != fs.FileType.File or not info.size:
                    continue
                with system.open_input_stream(place) as file:
                    rows.append((*rec, file.read()))
                size += info.size
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*columns, "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=[*columns, "content"])

    return _dealt(paths, paths.count()).mapInPandas(opened, f"{ddl}, content binary")


def as_uri(path: str) -> str:
    """A path as `_metadata.file_path` has it: what a URI may not hold is escaped, other alphabets are not."""
    return re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe="/@,;:$&+=_-!.~'()*"), path)
