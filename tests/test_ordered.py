"""Ordered scans give the same answer whether or not keys are sliced."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from matchlens.operators import asof, changes, combat, events, intervals, ordered
from matchlens.operators.ordered import SLICE, ordered_scan, text_place, with_slice
from matchlens.operators.quantiles import summarize

SKEWED = {"k": 0.5}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = 1 if rnd.random() < SKEWED["k"] else rnd.randint(2, 8)
        t = round(rnd.random() * 300, 1) if key != 1 else round(rnd.random() ** 3 * 900, 1)
        data.append((key, t, i, rnd.choice([None, rnd.randint(0, 4)]), rnd.random() < 0.3))
    return spark.createDataFrame(data, "k int, t double, id int, v int, probe boolean").cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("max_rows", [1, 20, 100])
def test_scan_slices_do_not_matter(rows, reverse, max_rows):
    outputs = {
        "prev": ("previous", F.col("v")),
        "last": ("fill", F.col("v")),
        "sum": ("total", F.col("v").cast("bigint")),
        "top": ("peak", F.col("v")),
    }
    plain = ordered_scan(rows, ["k"], ["t", "id"], outputs, reverse=reverse, max_rows=10**9)
    same(plain, ordered_scan(rows, ["k"], ["t", "id"], outputs, reverse=reverse, max_rows=max_rows))
    # Against a plain recomputation.
    got = {(r.k, r.id): r for r in plain.collect()}
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, []).append(r)
    for key, items in by_key.items():
        items.sort(key=lambda r: (r.t, r.id), reverse=reverse)
        prev, last, total, top = None, None, None, None
        for r in items:
            assert got[key, r.id].prev == prev
            if r.v is not None:
                last = r.v
                total = (total or 0) + r.v
                top = r.v if top is None else max(top, r.v)
            assert (got[key, r.id].last, got[key, r.id].sum, got[key, r.id].top) == (last, total, top)
            prev = r.v


def test_a_burst_at_one_moment_is_cut_too(spark):
    """One key with all rows at one time, a null key that is hot, and ordinary keys: no slice is above the bound, scans are right."""
    data = [(1, 5.0, i) for i in range(700)] + [(None, float(i % 3), i) for i in range(500)] + [(k, float(i), i) for k in (7, 8) for i in range(40)]
    df = spark.createDataFrame(data, "k int, t double, id int").repartition(5)
    cut = with_slice(df, ["k"], ["t", "id"], 100)
    sizes = {(r.k, r[SLICE]): r["count"] for r in cut.groupBy("k", SLICE).count().collect()}
    assert max(sizes.values()) <= 100 and sum(sizes.values()) == len(data)
    assert {k for k, s in sizes if s is None} == {7, 8} and len(sizes) > 12
    outputs = {"n": ("total", F.lit(1).cast("bigint")), "before": ("previous", F.col("id")), "top": ("peak", F.col("id"))}
    got = {(r.k, r.id): (r.n, r.before, r.top) for r in ordered_scan(df, ["k"], ["t", "id"], outputs, max_rows=100).collect()}
    for key in (1, None, 7, 8):
        run = sorted((t, i) for k, t, i in data if k == key)
        top = None
        for at, (_, i) in enumerate(run):
            top = i if top is None else max(top, i)
            assert got[key, i] == (at + 1, run[at - 1][1] if at else None, top)
    assert SLICE not in with_slice(df, ["k"], ["t", "id"], 1000).columns


def test_asof_matches_brute_force(rows):
    samples = rows.where(~F.col("probe")).select("k", "t", "id", "v")
    probes = rows.where("probe").select("k", "t", F.col("id").alias("pid"))
    kw = dict(time="t", probe_time="t", tie=["id"])
    plain = asof.asof_rows(samples, probes, ["k"], ["id", "v"], **kw)
    sliced = asof.asof_rows(samples, probes, ["k"], ["id", "v"], max_rows=10, **kw)
    same(plain, sliced)
    s = sorted(samples.collect(), key=lambda r: (r.t, r.id))
    for r in plain.collect():
        best = [x for x in s if x.k == r.k and x.t <= r.t]
        assert (r.sample.id if r.sample else None) == (best[-1].id if best else None)
    same(
        asof.asof_rows(samples, probes, ["k"], ["id"], following=True, clamp=True, **kw),
        asof.asof_rows(samples, probes, ["k"], ["id"], following=True, clamp=True, max_rows=10, **kw),
    )
    same(
        asof.interpolate(samples, probes, ["k"], ["v"], **kw), asof.interpolate(samples, probes, ["k"], ["v"], max_rows=10, **kw)
    )


def test_null_field_of_latest_sample_stays_null(spark):
    samples = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, None)], "k int, time_seconds double, w int")
    probes = spark.createDataFrame([(1, 2.0), (1, 1.5), (1, 0.5)], "k int, time_seconds double")
    got = {r.time_seconds: r.sample for r in asof.asof_rows(samples, probes, ["k"], ["w"]).collect()}
    assert got[2.0].w is None and got[2.0].time_seconds == 2.0
    assert got[1.5].w == 5 and got[0.5] is None
    const = asof.asof_const(samples, ["k"], 2.0, ["w"]).first().sample
    assert const.time_seconds == 2.0 and const.w is None


@pytest.mark.parametrize("groups", [[], ["k"]])
@pytest.mark.parametrize("weight", [None, "w"])
def test_distributed_summary_is_exact(rows, groups, weight):
    df = rows.withColumn("w", F.col("id") % 3)
    a = {tuple(r[g] for g in groups): r for r in summarize(df, "t", groups, weight, distributed=False).collect()}
    b = {tuple(r[g] for g in groups): r for r in summarize(df, "t", groups, weight, distributed=True).collect()}
    assert a.keys() == b.keys()
    for key in a:
        for c in ("n", "min", "p25", "median", "p75", "max", "mean"):
            assert b[key][c] == pytest.approx(a[key][c]), (key, c)


def test_summary_goldens(spark):
    four = spark.createDataFrame([(float(x),) for x in (40, 10, 30, 20)], "v double")
    for mode in (False, True):
        r = summarize(four, "v", distributed=mode).first()
        assert (r.n, r.min, r.p25, r["median"], r.p75, r.max, r.mean) == (4, 10, 17.5, 25, 32.5, 40, 25)
        empty = summarize(four.where("v < 0"), "v", distributed=mode).first()
        assert empty.n == 0 and empty["median"] is None and empty["min"] is None


def test_sessions(spark, rows):
    gaps = spark.createDataFrame([(1, t) for t in (0.0, 14.9, 29.9, 45.0)], "k int, t double")
    got = combat.loss_sessions(gaps, ["k"], 15.0, time="t", order=(), measures=[F.count(F.lit(1)).alias("n")]).collect()
    assert sorted((r.session, r.session_start, r.session_end, r.n) for r in got) == [(1, 0.0, 29.9, 3), (2, 45.0, 45.0, 1)]
    kw = dict(time="t", order=("id",))
    same(combat.number_sessions(rows, ["k"], 2.0, **kw), combat.number_sessions(rows, ["k"], 2.0, max_rows=7, **kw))


def test_compaction_is_idempotent(rows):
    once = changes.compact_changes(rows, ["k"], ["t", "id"], F.col("v"), max_rows=9)
    same(once, changes.compact_changes(rows, ["k"], ["t", "id"], F.col("v")))
    same(once, changes.compact_changes(once, ["k"], ["t", "id"], F.col("v")))


def test_text_place_orders_like_text(spark):
    words = ["/a/b/x1", "/a/b/x2", "/a/b/x10", "/a/b/", "/a/b/xé", "/a/b/y"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in text_place(df, "w").orderBy("_place", "w").collect()]
    assert got == sorted(words, key=lambda s: s.encode())
    odd = spark.createDataFrame([(f"data/{i:04d}",) for i in range(500)] + [("a/1",)], "w string")
    placed = text_place(odd, "w", ranges=8)
    assert placed.groupBy("_place").count().agg(F.max("count")).first()[0] < 200
    assert [r.w for r in placed.orderBy("_place", "w").limit(2).collect()] == ["a/1", "data/0000"]
    only = spark.createDataFrame([("same",), ("same",)], "w string")
    assert text_place(only, "w").count() == 2


@pytest.mark.parametrize("max_rows", [None, 5])
def test_greedy_match_against_restatement(spark, max_rows):
    rnd = random.Random(3)
    starts = [(k, i, round(rnd.random() * 30, 2)) for k in (1, 2) for i in range(40 if k == 1 else 5)]
    points = [(k, i, round(rnd.random() * 30, 2)) for k in (1, 2) for i in range(60 if k == 1 else 5)]
    got = combat.match_intervals(
        spark.createDataFrame(starts, "k int, start_id bigint, time_seconds double"),
        spark.createDataFrame(points, "k int, point_id bigint, time_seconds double"), ["k"], 1.5, max_rows=max_rows,
    )
    want = set()
    for key in (1, 2):
        used = set()
        free = sorted((t, i) for k, i, t in points if k == key)
        for t, i in sorted((t, i) for k, i, t in starts if k == key):
            hit = next((j for u, j in free if j not in used and t <= u < t + 1.5), None)
            if hit is not None:
                used.add(hit)
                want.add((key, i, hit))
    assert {(r.k, r.start_id, r.point_id) for r in got.collect()} == want
    assert len(want) > 20


@pytest.mark.parametrize("max_rows", [None, 5])
def test_lanes_against_restatement(spark, max_rows):
    rnd = random.Random(5)
    items = [(1, i, float(rnd.randint(0, 60)), float(rnd.choice([0, 1, 3, 9])), rnd.random() < 0.5) for i in range(80)]
    df = spark.createDataFrame(items, "k int, event_seq bigint, time_seconds double, build_time double, is_unit boolean")
    got = {r.event_seq: r.lane for r in intervals.lanes(df, ["k"], max_rows=max_rows).collect()}
    want, base = {}, 0
    for unit in (False, True):
        tracks = []
        for _, i, s, d, _ in sorted((x for x in items if x[4] == unit), key=lambda x: (x[2], x[1])):
            for lane, busy in enumerate(tracks):
                if not any(s < b + e and s + d > b for b, e in busy):
                    break
            else:
                lane = len(tracks)
                tracks.append([])
            tracks[lane].append((s, d))
            want[i] = base + lane
        base = len(tracks)
    assert got == want


@pytest.mark.parametrize("max_rows", [None, 6])
def test_supply_intervals(spark, max_rows):
    rnd = random.Random(11)
    samples = [("m", 1, float(i * rnd.choice([1, 2, 6])), rnd.choice([5, 9, 10, 12]), rnd.choice([10, 10, 10, 0]), i) for i in range(60)]
    df = spark.createDataFrame(samples, "replay_id string, owner int, time_seconds double, current int, max int, frame bigint")
    ranges = spark.createDataFrame([("m", 0.0, 200.0)], "replay_id string, range_min double, range_max double")
    got = [(r.start, r.end, r.state) for r in intervals.supply_intervals(df, ranges, max_rows=max_rows).orderBy("start").collect()]
    assert got == restated_intervals([(t, c, m) for _, _, t, c, m, _ in sorted(samples, key=lambda s: (s[2], s[5]))], 0.0, 200.0)


def restated_intervals(samples, lo, hi):
    def state(c, m):
        if m == 0:
            return "over" if c > 0 else "zero"
        return "capped" if c >= m else ("warn" if c / m >= 0.9 else "ok")

    severity = {"over": 3, "capped": 2, "warn": 1}
    earlier = [s for s in samples if s[0] <= lo]
    first = samples[0] if lo <= samples[0][0] else earlier[-1]
    points = [(lo, first)] + [(s[0], s) for s in samples if lo < s[0] < hi] + [(hi, None)]
    raw = [[a[0], b[0], state(*a[1][1:])] for a, b in zip(points, points[1:]) if b[0] > a[0]]

    def merge(xs):
        out = []
        for s, e, st in xs:
            if out and out[-1][2] == st:
                out[-1][1] = e
            else:
                out.append([s, e, st])
        return out

    once = merge(raw)
    final = []
    for i, (s, e, st) in enumerate(once):
        if st == "ok" and 0 < i < len(once) - 1 and e - s <= 5:
            p, n = once[i - 1][2], once[i + 1][2]
            if severity.get(p, 0) and severity.get(n, 0):
                st = p if severity[p] >= severity[n] else n
        final.append([s, e, st])
    return [tuple(x) for x in merge(final)]


def test_supply_gap_of_five_seconds(spark):
    def run(gap_end):
        data = [("m", 1, 0.0, 10, 10, 0), ("m", 1, 10.0, 1, 10, 1), ("m", 1, gap_end, 9, 10, 2)]
        df = spark.createDataFrame(data, "replay_id string, owner int, time_seconds double, current int, max int, frame bigint")
        ranges = spark.createDataFrame([("m", 0.0, 50.0)], "replay_id string, range_min double, range_max double")
        return [r.state for r in intervals.supply_intervals(df, ranges).orderBy("start").collect()]

    assert run(15.0) == ["capped", "warn"]
    assert run(15.1) == ["capped", "ok", "warn"]


def test_chained_starts(spark):
    catalog = spark.createDataFrame(
        [("Drone", "Zerg", "Unit", 12.0, 50, 0, 1.0, "Larva"), ("Hatchery", "Zerg", "Building", 75.0, 300, 0, 0.0, "Drone")],
        "name string, race string, type string, buildTime double, mineralCost int, gasCost int, supplyCost double, builtFrom string",
    )
    lines = spark.createDataFrame([("m", 0, "(2) 1:10 drone -> what -> Hatchery->drone"), ("m", 1, "bad")], "k string, line int, text string")
    got = [(r.item, r.time_seconds, r.track) for r in events.chained_starts(lines, catalog, ["k"]).orderBy("link").collect()]
    assert got == [("Drone", 70.0, 1), ("Hatchery", 82.0, 1), ("Drone", 157.0, 1)]


@pytest.mark.parametrize("max_rows", [None, 10])
def test_combat_places(spark, max_rows):
    """Enemy first, then category, name and original order; a match of one moment is cut into slices."""
    from matchlens.operators import combat

    kinds = ["worker", "unit", "building", "air", None]
    rows = [("m", 1, float(i // 40), ["own", "enemy"][i % 2], kinds[i % 5], f"u{i % 3}", i) for i in range(80)]
    rows += [(None, 1, None, "own", "unit", None, 500), ("n", 2, 1.0, "own", "unit", "x", 7)]
    df = spark.createDataFrame(rows, "replay_id string, self_owner int, time_seconds double, side string, category string, display_name string, frame long")
    out = combat.combat_places(df, max_rows=max_rows)
    assert out.columns == [*df.columns, "place"]
    got = {(r.replay_id, r.frame): r.place for r in out.collect()}
    want = sorted(rows[:80], key=lambda r: (r[2], r[3] == "own", {"worker": 0, "unit": 1, "building": 2}.get(r[4], 3), r[5], r[6]))
    assert got == {**{("m", r[6]): k + 1 for k, r in enumerate(want)}, (None, 500): 1, ("n", 7): 1}


def test_supply_intervals_shuffle_once(spark, monkeypatch):
    """Without a hot key all scans share one shuffle by participant and one count, also where the input is large."""
    counted = []
    monkeypatch.setattr(ordered, "is_small", lambda df, limit=0: False)
    monkeypatch.setattr(ordered, "hold", lambda df: counted.append(1) or df)
    df = spark.range(200).selectExpr("id % 3 as replay_id", "0 as owner", "cast(id as double) as time_seconds", "cast(id % 17 as int) as current", "10 as max", "id as frame")
    ranges = spark.range(3).selectExpr("id as replay_id", "0.0D as range_min", "300.0D as range_max")
    out = intervals.supply_intervals(df, ranges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert counted == [1] and plan.count("LeftOuter") == 0 and out.count() > 20


def test_counted_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Losses of ordinary matches go to as many tasks as their rows need, not to as few as their bytes fill."""
    monkeypatch.setattr(ordered, "is_small", lambda df: False)
    monkeypatch.setattr(ordered, "TASK_ROWS", 5)
    rows = spark.range(400).selectExpr(
        "id % 40 as replay_id", "id % 40 as self_owner", "id as frame", "cast(id as double) as time_seconds", "'own' as side", "'unit' as category", "'x' as display_name")
    out = combat.combat_places(rows)
    assert ", 80), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.replay_id, r.place) for r in out.collect()) == [(m, n) for m in range(40) for n in range(1, 11)]


def test_lines_of_large_inputs_are_not_counted(spark, monkeypatch):
    """A chain is one line of text: nothing is written or counted for it, and a hint, a sign and odd spaces are read as before."""
    def refuse(*a):
        raise AssertionError("staged")

    monkeypatch.setattr(ordered, "is_small", lambda df: False)
    monkeypatch.setattr(ordered, "stage", refuse)
    texts = ["(2)  1:05 a ->b", " -0:30   B", "(3) -2:10 a", "1:5 a", "1:05 ", "x 1:05 a", "10:00\ta->  A", "(x) 1:05 a", None]
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "k int, line int, text string").repartition(3, "k")
    catalog = spark.createDataFrame([("A", "z", "u", 7.0, "d"), ("b", "z", "u", 1.0, "d")], "name string, race string, type string, buildTime double, builtFrom string")
    got = events.chained_starts(lines, catalog, ["k"]).select("line", "link", "track", "item", "time_seconds").collect()
    assert sorted(tuple(r) for r in got) == [
        (0, 0, 1, "A", 65.0), (0, 1, 1, "b", 72.0), (1, 0, 0, "b", -30.0), (2, 0, 2, "A", -130.0),
        (6, 0, 0, "A", 600.0), (6, 1, 0, "A", 607.0)]


def test_summary_shrinks_matches_before_they_are_dealt(spark):
    from matchlens.operators import discovery

    rows = [(m, o, "PvZ" if m % 2 else None, " " if m % 3 else "Map", 100.0, "f", f"n{o}", f"n{o}", "Zerg" if o else "Protoss", "zerg", 1, 1) for m in range(6) for o in range(3)]
    parts = spark.createDataFrame(rows, "replay_id int, owner int, matchup string, map string, duration_seconds double, source_replay_filename string, name string, name_lc string, race string, race_lc string, as_self bigint, as_opponent bigint")
    out = discovery.corpus_summary(parts)
    got = {tuple(r) for r in out.collect()}
    assert got == {("matchup", "PvZ", 3, 9), ("matchup", "unknown", 3, 9), ("map", "Map", 2, 6), ("map", "unknown", 4, 12), ("race", "Zerg", 6, 12), ("race", "Protoss", 6, 6),
                   ("all", "all", 6, 18), ("players", "all", 3, 18)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [replay_id" in plan[plan.index("Generate"):]
