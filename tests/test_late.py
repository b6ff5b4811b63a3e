"""Windows and sessions with a side table for late rows: nothing is lost, repeats change nothing."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from matchlens.streaming import late

BASE = datetime(2024, 1, 1)
DELAY = 60


def batches(seed=3):
    """Five batches of (id, key, seconds); about a sixth of the rows is an hour behind its batch."""
    rnd, out, n = random.Random(seed), [], 0
    for b in range(5):
        rows = []
        for _ in range(60):
            back = 3600 if rnd.random() < 0.15 else rnd.randrange(0, 90)
            rows.append((n, rnd.choice("ab"), max(0, b * 900 + rnd.randrange(0, 900) - back)))
            n += 1
        rows += [(n, "a", None), (n + 1, None, b * 900 + 10), (n + 2, "b", b * 900 + 600)]
        n += 3
        out.append(rows)
    return out


def expected(parts, end_of):
    """Late ids, by the watermark that the batches before have set, and the rows that are not late."""
    newest, gone, kept = None, set(), []
    for rows in parts:
        mark = None if newest is None else newest - DELAY
        for i, k, t in rows:
            if t is None or (mark is not None and end_of(t) <= mark):
                gone.add(i)
            else:
                kept.append((i, k, t))
        newest = max([t for _, _, t in rows if t is not None] + ([] if newest is None else [newest]))
    return gone, kept, newest - DELAY


def slow_sessions(kept, gap):
    out = []
    for key in {k for _, k, _ in kept}:
        run = []
        for t in sorted(t for _, k, t in kept if k == key):
            if run and t - run[-1] > gap:
                out.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((key, run[0], run[-1], len(run)))
    return Counter(out)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("late"))


def run(spark, source, tmp_path, kind, again=False):
    """One stream run for each batch, each in a folder that the stream finds later; `again` repeats every batch's work."""
    root, check, folder = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    work = late.merge_batch(kind, root, DELAY)
    for b, rows in enumerate(batches()):
        df = spark.createDataFrame([(i, k, None if t is None else BASE + timedelta(seconds=t)) for i, k, t in rows], "id long, key string, ts timestamp")
        df.write.parquet(f"{folder}/{b}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(folder)
        late.start(stream, kind, root, check, delay_seconds=DELAY).awaitTermination()
        if again:
            work(df, b)  # what a restart after a failure does
    return root


def seconds(t):
    return int((t - BASE).total_seconds())


@pytest.mark.parametrize("again", [False, True])
def test_windows(spark, source, tmp_path, again):
    root = run(spark, source, tmp_path, late.Windows(("key",), seconds=30), again)
    gone, kept, mark = expected(batches(), lambda t: t // 30 * 30 + 30)
    assert {r.id for r in late.late(spark, root).collect()} == gone and len(gone) > 20
    want = Counter((k, t // 30 * 30) for _, k, t in kept)
    closed = {(r.key, seconds(r.window_start)): r.losses for r in late.closed(spark, root).collect()}
    still = {(r.key, seconds(r.window_start)): r.losses for r in late.still_open(spark, root).collect()}
    assert not set(closed) & set(still) and {**closed, **still} == want
    assert all((t + 30 <= mark) == ((k, t) in closed) for k, t in want)
    assert sum(want.values()) + len(gone) == sum(map(len, batches()))
    assert len(late._batches(spark, root, "open")) == 1 + late.KEPT_STATES


def test_sessions(spark, source, tmp_path):
    root = run(spark, source, tmp_path, late.Sessions(("key",), seconds=15), again=True)
    gone, kept, mark = expected(batches(), lambda t: t + 15)
    assert {r.id for r in late.late(spark, root).collect()} == gone
    done = Counter((r.key, seconds(r.first_ts), seconds(r.last_ts), r.losses) for r in late.closed(spark, root).collect())
    still = Counter((r.key, seconds(r.first_ts), seconds(r.last_ts), r.losses) for r in late.still_open(spark, root).collect())
    assert sum(n * r[3] for r, n in (done + still).items()) + len(gone) == sum(map(len, batches()))
    assert all((r[2] + 15 <= mark) for r in done) and not any(r[2] + 15 <= mark for r in still)
    # a row that is not late may still fall between sessions that have closed; then it is a session of its own
    both, want = done + still, slow_sessions(kept, 15)
    assert sum((want - both).values()) <= 2 and (want & both).total() > 50


def test_session_joined_after_its_end(spark, tmp_path):
    """A row in time within the gap of a session that has ended belongs to it; equal times of two batches are one place."""
    root, kind = str(tmp_path / "out"), late.Sessions(("key",), seconds=15)
    work = late.merge_batch(kind, root, DELAY)
    rows = lambda *at: spark.createDataFrame([(k, BASE + timedelta(seconds=t)) for k, t in at], "key string, ts timestamp")
    work(rows(("a", 10), ("b", 30), ("z", 90)), 0)  # watermark 30: a's session has ended
    assert {r.key for r in late.closed(spark, root).collect()} == {"a"}
    work(rows(("a", 20), ("b", 30), ("b", 45), ("z", 200)), 1)
    found = [*late.closed(spark, root).collect(), *late.still_open(spark, root).collect()]
    assert {(r.key, seconds(r.first_ts), seconds(r.last_ts), r.losses) for r in found} == {
        ("a", 10, 20, 2), ("b", 30, 45, 3), ("z", 90, 90, 1), ("z", 200, 200, 1)}
    assert len(found) == 4 and late.late(spark, root).count() == 0


def test_stream_takes_in_a_manifest_ahead_of_its_archive(spark, tmp_path):
    from fixtures import write_match

    from matchlens.schema import open_corpus
    from matchlens.streaming import jobs

    root, store, mark = tmp_path / "in", str(tmp_path / "corpus"), str(tmp_path / "cp")
    p = {"owner": 1, "name": "x", "race": "zerg", "lines": ["00:10 Drone"]}

    def step():
        jobs.ingest_stream(spark, str(root), store, mark, per_trigger=3, buckets=2).awaitTermination()
        waiting = {r.replay_id for r in jobs.open_manifests(spark, store).collect()}
        wrong = {(r.replay_id, r.reason) for r in jobs.current_errors(spark, store).collect()}
        return {r.replay_id for r in open_corpus(spark, store).replays.collect()}, waiting, wrong

    folder = write_match(root, "a", "m1", [p, {**p, "owner": 2}])
    one, two = (folder / f"player_{i}.zip" for i in (1, 2))
    held = one.read_bytes(), two.read_bytes()
    one.unlink(), two.unlink()
    write_match(root, "b", "m2", [p])
    gone = {("m1", "archive not found")}
    assert step() == ({"m2"}, {"m1"}, gone)
    one.write_bytes(held[0])
    write_match(root, "c", "m3", [{**p, "lines": ["oops"]}])
    have, waiting, wrong = step()
    assert (have, waiting) == ({"m2"}, {"m1"}) and wrong == gone | {("m3", "invalid line: oops")}
    two.write_bytes(held[1])
    have, waiting, wrong = step()
    assert (have, waiting) == ({"m1", "m2"}, set()) and wrong == {("m3", "invalid line: oops")}
    assert open_corpus(spark, store).players.where("replay_id = 'm1'").count() == 2
    before = step()
    jobs.ingest_batch(store, mark, 2)(spark.createDataFrame([(f"file:{two}",)], "path string"), 1)  # a batch once more after a failure
    assert step()[0] == before[0]


def test_backlog_is_taken_in_by_one_batch(spark, tmp_path):
    """More files than a thousand waiting at once cost one commit, not one for every thousand."""
    from matchlens.streaming import jobs

    root = tmp_path / "in"
    for i in range(1001):
        (root / str(i)).mkdir(parents=True)
        (root / str(i) / "manifest.json").write_text("{}")
    sizes = []
    query = jobs.analysis_stream(spark, str(root)).writeStream.foreachBatch(lambda df, _: sizes.append(df.count()))
    query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [1001]


def test_batch_opens_its_files_by_path(spark, tmp_path, monkeypatch):
    """A batch lists no folder again, and Spark's own listings take a few tasks for each core, not one for each path."""
    from fixtures import write_match
    from pyspark.sql import DataFrameReader

    from matchlens.schema import open_corpus
    from matchlens.streaming import jobs

    store, setting = str(tmp_path / "corpus"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.unset(setting)
    jobs.analysis_stream(spark, str(tmp_path))
    assert int(spark.conf.get(setting)) <= 4 * spark.sparkContext.defaultParallelism
    folders = [write_match(tmp_path / "in", f"{i}", f"m{i}", [{"owner": 1, "name": "x", "race": "zerg", "lines": ["00:10 Drone"]}]) for i in range(3)]
    paths = [(f"file:{f}/{name}",) for f in folders for name in ("manifest.json", "player_1.zip")]
    inner, loads = DataFrameReader.load, []
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: loads.append(a) or inner(self, *a, **k))
    jobs.ingest_batch(store, "s", 2)(spark.createDataFrame(paths, "path string"), 0)
    assert loads == [] and {r.replay_id for r in open_corpus(spark, store).replays.collect()} == {"m0", "m1", "m2"}
