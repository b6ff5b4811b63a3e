"""Timeline reduction against hand-made snapshots and a plain re-statement."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchlens.operators import ordered, reduction
from matchlens.schema import SNAPSHOT
from matchlens.streaming import jobs

NAMES = {7: "scv", 35: "larva", 36: "egg", 37: "zergling", 38: "hydralisk", 41: "drone", 106: "command_center", 131: "hatchery", 132: "lair", 141: "spire", 142: "spawning_pool"}


def unit(ident, type_id, category="building", **kw):
    base = dict(id=ident, unit_type=NAMES.get(type_id), unit_type_id=type_id, category=category, build_queue_unit_ids=[], upgrade_in_progress=None,
                tech_in_progress=None, morphing_building=None, morph_target_unit_type_id=None, build_time=None, remaining_build_time=None)
    return {**base, **kw}


def owner(units, **kw):
    base = dict(name=None, minerals=None, gas=None, gathered_minerals=None, gathered_gas=None, workers_alive=None, supply_current=None, supply_max=None, unit_counts=None)
    return {**base, **kw, "units": units}


def frames(spark, snaps, rid="m"):
    rows = [(rid, f, {str(k): v for k, v in owners.items()}, deaths) for f, owners, deaths in snaps]
    return spark.createDataFrame(rows, f"replay_id string, {SNAPSHOT}")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(list(NAMES.items()), "type_id int, type_name string")


def listed(events):
    return sorted((r.frame, r.owner, r.item) for r in events.collect())


def test_two_owners(spark, names):
    snaps = [
        (0, {3: owner([unit(1, 131)], name="MysteriousZerg", minerals=50, gas=0, unit_counts={"hatchery": 1, "siege_tank_turret": 1}, supply_current=4, supply_max=9),
             5: owner([unit(10, 106)], name="", minerals=50, gas=0)}, []),
        (48, {3: owner([unit(1, 131), unit(2, 36, "unit", build_queue_unit_ids=[41])], minerals=75, gas=0, unit_counts={"hatchery": 1}, supply_current=4, supply_max=9),
              5: owner([unit(10, 106, build_queue_unit_ids=[7])], name="BigTerran")}, [dict(id=9, owner=5, unit_type="goliath_turret", unit_type_id=1, category="unit", pos_x=1, pos_y=2)]),
        (600, {3: owner([unit(1, 131, upgrade_in_progress=27)], supply_current=5, supply_max=9)}, [dict(id=2, owner=3, unit_type="siege_tank_tank", unit_type_id=5, category="unit", pos_x=1, pos_y=2)]),
    ]
    out = reduction.reduce_timeline(frames(spark, snaps), names)
    assert listed(out["events"]) == [(48, 3, "Drone"), (48, 5, "SCV"), (600, 3, "Metabolic Boost")]
    assert [(r.frame, r.current) for r in out["supply"].orderBy("frame").collect()] == [(0, 4), (600, 5)]
    assert [r.frame for r in out["unit_counts"].collect()] == [0]
    assert [(r.owner, r.unit_type) for r in out["deaths"].collect()] == [(3, "siege_tank")]
    people = {r.owner: (r.name, r.race) for r in out["participants"].collect()}
    assert people == {3: ("MysteriousZerg", "zerg"), 5: ("BigTerran", "terran")}
    m = out["matches"].first()
    assert (m.matchup, m.duration_seconds) == ("ZvT", 600 * 42 / 1000)
    s = out["sampling"].first()
    assert (s.max_frame_delta, s.frames_skipped) == (552, True)
    explicit = reduction.reduce_timeline(frames(spark, snaps), names, owners=[3, 8])
    assert {r.owner: r.name for r in explicit["participants"].collect()} == {3: "MysteriousZerg", 8: "Player 9"}


def test_backdating_and_morph(spark, names):
    seen = [(100, {3: owner([unit(1, 131)])}, []), (200, {3: owner([unit(1, 131), unit(2, 141, build_time=120, remaining_build_time=20)])}, [])]
    assert listed(reduction.build_events(reduction.explode_timeline(frames(spark, seen)).units, names)) == [(100, 3, "Spire")]
    morph = [
        (0, {3: owner([unit(1, 131)])}, []), (100, {3: owner([unit(1, 131, morph_target_unit_type_id=132, morphing_building=True, build_queue_unit_ids=[132])])}, []),
        (340, {3: owner([unit(1, 132)])}, []),
    ]
    assert listed(reduction.build_events(reduction.explode_timeline(frames(spark, morph)).units, names)) == [(100, 3, "Lair")]


def test_appearances_are_opt_in(spark, names):
    snaps = [(0, {3: owner([unit(1, 131)])}, []), (10, {3: owner([unit(1, 131), unit(2, 37, "unit"), unit(3, 36, "unit"), unit(4, 37, "resource")])}, []),
             (20, {3: owner([unit(2, 37, "unit"), unit(3, 38, "unit")])}, [])]
    t = reduction.explode_timeline(frames(spark, snaps))
    assert listed(reduction.build_events(t.units, names)) == []
    assert listed(reduction.build_events(t.units, names, include_unit_appearances=True)) == [(10, 3, "Zergling"), (20, 3, "Hydralisk")]
    start = reduction.build_events(t.units, names, include_initial=True)
    assert listed(reduction.in_event_order(start)) == [(0, 3, "Hatchery")]


def restated(snaps, include_initial=False):
    """Direct state machine over the snapshots."""
    types, queues, told, research, out, first = {}, {}, {}, {}, set(), True
    for frame, owners, _ in snaps:
        current = {}
        for o, data in owners.items():
            current[o] = set()
            for u in data["units"]:
                key = (o, u["id"])
                if include_initial or not first:
                    cands = []
                    if u["morph_target_unit_type_id"] is not None:
                        cands.append(u["morph_target_unit_type_id"])
                    elif u["category"] == "building" and types.get(key) != u["unit_type_id"]:
                        cands.append(u["unit_type_id"])
                    q = Counter(u["build_queue_unit_ids"])
                    for target in (q - queues.get(key, Counter())):
                        if 106 <= target <= 172:
                            if u["morphing_building"]:
                                cands.append(target)
                        elif target != 36:
                            out.add((frame, o, target))
                    for target in cands:
                        if told.get(key) != target:
                            told[key] = target
                            out.add((frame, o, target))
                    queues[key] = q
                if u["upgrade_in_progress"] is not None:
                    current[o].add(u["upgrade_in_progress"])
                types[key] = u["unit_type_id"]
            if include_initial or not first:
                for up in current[o] - research.get(o, set()):
                    out.add((frame, o, f"up{up}"))
        research, first = current, False
    return out


def random_snaps(seed):
    rnd = random.Random(seed)
    snaps = []
    for frame in range(0, 60, 2):
        owners = {}
        for o in (1, 2):
            if rnd.random() < 0.2:
                continue
            units = [
                unit(i, rnd.choice([131, 132, 141, 37]), rnd.choice(["building", "unit"]), build_queue_unit_ids=[rnd.choice([37, 38, 36, 132, 141]) for _ in range(rnd.randint(0, 3))],
                     morphing_building=rnd.random() < 0.5, morph_target_unit_type_id=rnd.choice([None, None, 132, 141]), upgrade_in_progress=rnd.choice([None, 0, 1]))
                for i in range(4) if rnd.random() < 0.8
            ]
            owners[o] = owner(units)
        snaps.append((frame, owners, []))
    return snaps


@pytest.mark.parametrize("include_initial, max_rows", [(False, None), (True, None), (False, 5)])
def test_against_state_machine(spark, names, include_initial, max_rows):
    # Keep at least one unit row in the first snapshot, so that ordinals agree.
    snaps = random_snaps(1)
    t = reduction.explode_timeline(frames(spark, snaps), max_rows=max_rows)
    got = reduction.build_events(t.units, names, include_initial=include_initial, max_rows=max_rows)
    label = {k: " ".join(p.capitalize() for p in v.split("_")) for k, v in NAMES.items()}
    label.update({"up0": "Infantry Armor", "up1": "Vehicle Plating"})
    assert {(r.frame, r.owner, r.item) for r in got.collect()} == {(f, o, label[x]) for f, o, x in restated(snaps, include_initial)}


def test_series_are_planned_when_asked_for(spark, names):
    """The deaths need no scan of the units."""
    series = reduction.reduce_timeline(frames(spark, random_snaps(3)), names)
    assert {"deaths", "events", "participants"} <= set(series) and not series._made
    assert series["deaths"].count() == 0 and set(series._made) == {"deaths"}


def test_derived_snapshots_are_written_once(spark, names, monkeypatch):
    snaps = random_snaps(3)
    raw = frames(spark, snaps).groupBy("replay_id", "frame").agg(F.first("owners").alias("owners"), F.first("deaths").alias("deaths"))
    want = listed(reduction.build_events(reduction.explode_timeline(raw).units, names))
    monkeypatch.setattr(reduction, "SMALL_TIMELINE_BYTES", -1)
    t = reduction.explode_timeline(raw)
    assert t.deaths.count() == 0 and "_written" not in vars(t)  # scalars and deaths alone need no copy
    assert t.units.count() and ordered.is_derived(raw) and not ordered.is_derived(t.owners) and not ordered.is_derived(t.deaths)
    assert listed(reduction.build_events(t.units, names)) == want


@pytest.mark.parametrize("max_rows", [None, 5])
def test_one_scan_for_types_and_queues(spark, names, max_rows):
    """Candidates of one pass are those of the two steps, and no second scan is planned for them."""
    units, known = reduction._named_units(reduction.explode_timeline(frames(spark, random_snaps(4)), max_rows=max_rows).units, names)
    two = reduction.building_candidates(units, known, max_rows=max_rows).unionByName(reduction._with_target_name(
        reduction.queue_increments(units, max_rows=max_rows).where(F.col("target").between(106, 172) & F.coalesce("morphing_building", F.lit(False)))
        .withColumn("target_name", F.lit(None).cast("string")), known).select(
        *reduction.KU, "frame", "pos", "build_time", "remaining_build_time", "target", "target_name"))
    one = reduction.start_candidates(reduction.unit_steps(units, max_rows=max_rows), known)
    shown = lambda df: Counter(tuple(r) for r in df.select(*reduction.KU, "frame", "pos", "target", "target_name").collect())
    assert shown(one) == shown(two) and len(shown(one)) > 20


def test_stream_matches_state_machine(spark, tmp_path):
    """Snapshots arriving in three files give the starts of the batch reduction."""
    snaps = random_snaps(2)
    want = {(f, o, x) for f, o, x in restated(snaps)}
    units = reduction.explode_timeline(frames(spark, snaps)).units.withColumn("ts", F.timestamp_seconds(F.col("frame") * 1000 + 10**9))
    src = tmp_path / "in"
    for i in range(3):
        units.where((F.col("frame") >= i * 20) & (F.col("frame") < i * 20 + 20)).coalesce(1).write.mode("append").parquet(str(src))
    schema = units.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    jobs.run_available(jobs.building_starts(stream(), transient_ids=[36]), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = {(r.frame, r.owner, r.target) for r in spark.read.parquet(str(tmp_path / "o1")).where("not late").collect()}
    assert got == {w for w in want if not isinstance(w[2], str)}
    jobs.run_available(jobs.research_starts(stream(), stride=2), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = {(r.frame, r.owner, f"up{r.ident}") for r in spark.read.parquet(str(tmp_path / "o2")).where("not late").collect()}
    assert got == {w for w in want if isinstance(w[2], str)}


def test_stream_ingest(spark, tmp_path):
    from fixtures import write_match

    from matchlens.schema import open_corpus

    root, store, mark = tmp_path / "in", str(tmp_path / "corpus"), str(tmp_path / "cp")
    p = {"owner": 1, "name": "x", "race": "zerg", "lines": ["00:10 Drone"]}
    write_match(root, "a", "m1", [p])
    jobs.ingest_stream(spark, str(root), store, mark, per_trigger=1, buckets=2).awaitTermination()
    write_match(root, "b", "m2", [p])
    write_match(root, "c", "m3", [{**p, "lines": ["oops"]}])
    write_match(root, "d", "m1", [{**p, "lines": ["00:20 Drone", "00:30 Drone"]}])
    jobs.ingest_stream(spark, str(root), store, mark, per_trigger=10, buckets=2).awaitTermination()
    c = open_corpus(spark, store)
    assert {r.replay_id: r["count"] for r in c.build_order_events.groupBy("replay_id").count().collect()} == {"m1": 2, "m2": 1}
    errors = spark.read.parquet(store + "/_errors")
    assert [r.replay_id for r in errors.collect()] == ["m3"]

    # A manifest ahead of its archive: an error now, taken in once the archive is there.
    folder = write_match(root, "e", "m4", [p])
    archive = (folder / "player_1.zip").read_bytes()
    (folder / "player_1.zip").unlink()
    jobs.ingest_stream(spark, str(root), store, mark, buckets=2).awaitTermination()
    assert jobs.retry_missing(spark, str(root), store, buckets=2).count() == 1
    (folder / "player_1.zip").write_bytes(archive)
    assert jobs.retry_missing(spark, str(root), store, buckets=2).count() == 0
    assert {r.replay_id for r in open_corpus(spark, store).replays.collect()} == {"m1", "m2", "m4"}


@pytest.mark.parametrize("max_rows", [None, 5])
def test_unit_starts_by_batches(spark, tmp_path, monkeypatch, max_rows):
    """Batches of a stream give the starts of the keyed operator, without a Python call per unit; late rows stand beside them."""
    from matchlens.streaming import starts

    if max_rows:
        monkeypatch.setattr(ordered, "is_small", lambda df, limit=0: False)
        monkeypatch.setattr(ordered, "MAX_ROWS", max_rows)
    snaps = random_snaps(2)
    want = {w for w in {(f, o, x) for f, o, x in restated(snaps)} if not isinstance(w[2], str)}
    units = reduction.explode_timeline(frames(spark, snaps)).unit_rows.withColumn("ts", F.timestamp_seconds(F.col("frame") + 10**9))
    src, root, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for lo in (0, 20, 40):
        units.where((F.col("frame") >= lo) & (F.col("frame") < lo + 20)).write.mode("append").parquet(src)
        rows = spark.readStream.schema(units.schema).parquet(src)
        starts.start(rows, root, mark, transient_ids=[36]).awaitTermination()
    held = spark.read.parquet(f"{root}/state/batch=2")
    assert {r.unit_id for r in units.select("unit_id").distinct().collect()} == {r.unit_id for r in held.collect()}
    units.where("frame = 3").write.mode("append").parquet(src)
    starts.start(spark.readStream.schema(units.schema).parquet(src), root, mark, transient_ids=[36]).awaitTermination()
    found = starts.starts(spark, root)
    assert {(r.frame, r.owner, r.target) for r in found.where("not late").collect()} == want
    assert found.where("batch < 3 and late").count() == 0
    assert found.where("batch = 3").count() == found.where("late").count() == units.where("frame = 3").count()
    assert "Python" not in spark._jvm.PythonSQLUtils.explainString(
        starts.find_starts(units, held)._jdf.queryExecution(), "simple") and spark.read.parquet(f"{root}/state/batch=3").count() == held.count()


def test_forgotten_units_are_late_behind_the_watermark(spark):
    from matchlens.streaming import starts

    row = [(1, 1, 7, 5, 40, "unit", [37], None, False), (1, 1, 8, 5, 40, "unit", [37], None, False)]
    units = spark.createDataFrame(
        row, "replay_id long, owner int, unit_id int, frame int, unit_type_id int, category string, build_queue_unit_ids array<int>,"
        " morph_target_unit_type_id int, morphing_building boolean").withColumn("ts", F.timestamp_seconds(F.lit(100)))
    held = spark.createDataFrame([(1, 1, 7, 4, 40, [], 0, None)],
                                 "replay_id long, owner int, unit_id int, frame int, unit_type_id int, _q array<int>, at long, announced int")
    found = starts.find_starts(units, held, 200_000_000)
    assert {(r.unit_id, r.late) for r in found.collect()} == {(7, False), (8, True)}
    assert {(r.unit_id, r.frame) for r in starts.next_state(units, held, found, 200_000_000).collect()} == {(7, 5)}


def test_snapshots_take_one_shuffle(spark):
    from matchlens.plans.adapters import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").snapshots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_race_needs_no_snapshot_numbers(spark):
    from matchlens.plans import QUERIES

    plan = QUERIES["race_mode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_units_are_shuffled_once(spark, names):
    """Numbering, research and appearances go on where the units of a match lie."""
    snaps = random_snaps(5)
    t = reduction.explode_timeline(frames(spark, snaps))

    def shuffles(df):
        df._jdf.queryExecution().assertAnalyzed()
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(replay_id")

    assert shuffles(reduction.research_starts(t.researching)) == 1
    units, known = reduction._named_units(t.units, names)
    assert shuffles(reduction.appearances(reduction.unit_steps(units), known).groupBy(*reduction.K, "frame").count()) == 1


@pytest.mark.parametrize("max_rows", [None, 5])
def test_appearances_are_units_that_started_nothing(spark, names, max_rows):
    """The one scan gives what the starts joined back gave, also where snapshots without units are counted."""
    snaps = [(-1, {}, []), *random_snaps(6)]
    t = reduction.explode_timeline(frames(spark, snaps), max_rows=max_rows)
    assert {(r.frame, r.ordinal) for r in t.units.select("frame", "ordinal").collect()} <= {(f, i + 1) for i, (f, _, _) in enumerate(snaps)}
    units, known = reduction._named_units(t.units, names)
    steps = reduction.unit_steps(units, max_rows=max_rows)
    own = reduction.building_starts(reduction.start_candidates(steps, known), max_rows=max_rows).where("pos = -1").select(*reduction.KU, F.col("seen_frame").alias("frame"))
    fresh = steps.where("ordinal > 1 and (_prev_type is null or _prev_type <> unit_type_id) and category <> 'building' and unit_type not in ('egg', 'cocoon', 'lurker_egg')")
    want = Counter(tuple(r) for r in fresh.join(own, [*reduction.KU, "frame"], "left_anti").select(*reduction.K, "frame", "unit_type").collect())
    assert Counter(tuple(r) for r in reduction.appearances(steps, known, max_rows=max_rows).collect()) == want and len(want) > 20
