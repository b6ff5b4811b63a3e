"""Commits over all tables: all or nothing, replaced matches, two writers, compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchlens.operators import ordered
from matchlens.schema import TABLES, open_corpus
from matchlens.sources import sinks, snapshots


def tables(spark, ids, mark, events=2):
    """Rows of every table for some matches; `mark` tells commits apart."""
    base = spark.createDataFrame([(i,) for i in ids], "replay_id string")
    out = {}
    for name in snapshots.FACTS:
        layout = [part.split() for part in TABLES[name].split(",")]
        rows = base if name in ("replays", "players") else base.join(spark.range(events).select("id"))
        cells = {"replay_id": F.col("replay_id"), "owner": F.lit(1), "matchup": F.lit(mark), "name": F.lit(mark), "item": F.lit(mark), "category": F.lit(mark)}
        out[name] = rows.select(*[cells.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in layout])
    return out


def state(spark, root, version=None):
    c = open_corpus(spark, root, version=version)
    matches = {r.replay_id: r.matchup for r in c.replays.collect()}
    counts = {n: {r.replay_id: r["count"] for r in df.groupBy("replay_id").count().collect()} for n, df in c.tables().items()}
    marks = {(r.replay_id, r.item) for r in c.build_order_events.collect()}
    return matches, counts, marks


def broken(good, name):
    """The tables with one that fails while it is written."""
    fail = F.raise_error(F.lit("forced")).cast("string")
    return {**good, name: good[name].withColumn("replay_id", F.when(F.col("replay_id") == "b", fail).otherwise(F.col("replay_id")))}


def test_failure_between_tables_leaves_the_old_corpus(spark, tmp_path):
    root = str(tmp_path / "corpus")
    snapshots.commit(tables(spark, "abc", "v1"), root)
    before = state(spark, root)
    for name in ("players", "economy_samples", "death_events"):
        with pytest.raises(Exception, match="forced"):
            snapshots.commit(broken(tables(spark, "bcd", "v2", 3), name), root)
        assert state(spark, root) == before and snapshots.versions(spark, root) == [1]
    snapshots.commit(tables(spark, "bcd", "v2", 3), root)
    matches, counts, marks = state(spark, root)
    assert matches == {"a": "v1", "b": "v2", "c": "v2", "d": "v2"}
    assert counts["build_order_events"] == counts["death_events"] == {"a": 2, "b": 3, "c": 3, "d": 3} and counts["players"] == dict.fromkeys("abcd", 1)
    assert marks == {("a", "v1"), ("b", "v2"), ("c", "v2"), ("d", "v2")}
    assert state(spark, root, 1) == before  # an opened version does not change
    gone = snapshots.remove_unused(spark, root, keep=1)
    assert len(gone) == 1 + 3 + 6 + 1  # tables that the failed commits had written whole, and the first commit's empty note
    assert state(spark, root)[0] == matches


def test_commit_is_repeatable_and_removes(spark, tmp_path):
    root = str(tmp_path / "corpus")
    for _ in range(3):
        snapshots.commit(tables(spark, "ab", "v1"), root)
    assert state(spark, root)[1]["supply_samples"] == {"a": 2, "b": 2}
    snapshots.commit({n: df.limit(0) for n, df in tables(spark, "a", "x").items()}, root, ids=spark.createDataFrame([("a",)], "replay_id string"))
    assert state(spark, root)[0] == {"b": "v1"}
    n = len(snapshots.versions(spark, root))
    for batch, mark in ((0, "s0"), (0, "again"), (1, "s1"), (0, "late")):
        snapshots.commit(tables(spark, "b", mark), root, tag=("stream", batch))
    assert state(spark, root)[0] == {"b": "s1"} and len(snapshots.versions(spark, root)) == n + 2
    with pytest.raises(ValueError, match="lacks tables: players"):
        snapshots.commit({k: v for k, v in tables(spark, "a", "x").items() if k != "players"}, root)
    with pytest.raises(ValueError, match="no snapshot 99"):
        open_corpus(spark, root, version=99)


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second of two writers is built on the first one's snapshot; nothing of either is lost."""
    root = str(tmp_path / "corpus")
    snapshots.commit(tables(spark, "ab", "v1"), root)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, snapshots.Snapshot(1))
    publish, first = snapshots.publish, []

    def overtaken(spark_, root_, new):
        if not first:
            first.append(new)
            other = tables(spark, "bc", "other")
            monkeypatch.setattr(snapshots, "publish", publish)
            snapshots.commit(other, root)
        publish(spark_, root_, new)

    monkeypatch.setattr(snapshots, "publish", overtaken)
    snapshots.commit(tables(spark, "cd", "mine"), root)
    assert state(spark, root)[0] == {"a": "v1", "b": "other", "c": "mine", "d": "mine"}
    assert state(spark, root)[1]["economy_samples"] == dict.fromkeys("abcd", 2)


def test_compaction(spark, tmp_path):
    root = str(tmp_path / "corpus")
    for ids, mark in (("abc", "1"), ("cd", "2"), ("de", "3"), ("a", "4")):
        snapshots.commit(tables(spark, ids, mark), root)
    before = state(spark, root)
    assert before[0] == {"a": "4", "b": "1", "c": "2", "d": "3", "e": "3"}
    held = open_corpus(spark, root)
    one = snapshots.compact(spark, root)
    assert len(one.commits) == 1 and state(spark, root) == before
    sinks.write_tables(tables(spark, "e", "5"), root, buckets=2)
    assert state(spark, root)[0] == {**before[0], "e": "5"} and state(spark, root)[1]["players"] == dict.fromkeys("abcde", 1)
    assert held.replays.count() == 5
    snapshots.compact(spark, root, below_bytes=0)  # nothing is small: no rows move
    assert state(spark, root)[0]["e"] == "5"


def test_large_commit_is_not_dealt_again(spark, tmp_path, monkeypatch):
    """Rows of large sources are written in the partitions they come in; what readers see is the same."""
    rows = {n: df.repartition(3, "replay_id") for n, df in tables(spark, "abcdefghijkl", "v1").items()}
    seen, files = [], []
    for root, small in ((str(tmp_path / "small"), True), (str(tmp_path / "large"), False)):
        monkeypatch.setattr(ordered, "is_small", lambda df, small=small: small)
        snapshots.commit(rows, root, parts=1)
        seen.append(state(spark, root))
        files.append(len(spark.read.parquet(f"{root}/build_order_events").inputFiles()))
    assert seen[0] == seen[1] and files[0] == 1 and files[1] > 1
