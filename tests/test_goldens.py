"""Results on small hand-made corpora."""

from __future__ import annotations

import pytest
from fixtures import ANALYTICS, DISCOVERY, PLAN, build_corpus
from pyspark.sql import functions as F

from matchlens.functions import text
from matchlens.operators import cards, combat, discovery, events, features, losses, pattern, quality, samples, scope
from matchlens.operators.pattern import Event
from matchlens.operators.starters import STARTERS
from matchlens.sql import bounded_sql

CATALOG = "name string, race string, type string, buildTime double, mineralCost int, gasCost int, supplyCost double, builtFrom string"


@pytest.fixture(scope="module")
def one(spark):
    return build_corpus(spark, [ANALYTICS])


@pytest.fixture(scope="module")
def two(spark):
    return build_corpus(spark, PLAN)


def parts(c, **kw):
    return scope.participants(c.replays, c.players, **kw)


def test_timing_and_order(one):
    p = parts(one, player="PBJT")
    r = events.event_timing_distribution(one.build_order_events, p, "spire").first()
    assert r.sample_size == 1 and {r.min, r.p25, r["median"], r.p75, r.max} == {255.0} and r.median_clock == "4:15" and r.hint is None
    none = events.event_timing_distribution(one.build_order_events, p, "Hive").first()
    assert none.sample_size == 0 and none["median"] is None and none.median_clock is None and "Hive" in none.hint
    summary, pairs = events.event_before_event(one.build_order_events, p, "Lair", "SPIRE")
    s = summary.first()
    assert (s.sample_size, s.match_count, s.percentage, s.missing_first_count) == (1, 1, 100.0, 0)
    assert [r.delta for r in events.pair_examples(pairs, one.players, True).collect()] == [39.0]
    zero = events.event_before_event(one.build_order_events, p, "Hive", "Spire")[0].first()
    assert (zero.sample_size, zero.percentage, zero.missing_first_count, zero.missing_second_count) == (0, 0.0, 1, 0)
    ex = events.timing_examples(events.event_timings(one.build_order_events, p, "Spire"), one.players).first()
    assert (ex.opponent_name, ex.time) == ("Scan", "4:15")


def test_samples_and_losses(one):
    p = parts(one, player="pbjt")
    comp = {r.unit: r["median"] for r in samples.composition_snapshot(one.unit_count_samples, p, 420, ["Mutalisk", "Drone", "Larva"]).collect()}
    assert comp == {"Mutalisk": 8, "Drone": 31}
    eco = {r.measure: r["median"] for r in samples.economy_distribution(one.economy_samples, p, 420).collect()}
    assert eco == {"workers": 31, "minerals": 150, "gas": 80}
    scan = {r.measure: r.n for r in samples.economy_distribution(one.economy_samples, parts(one, player="scan"), 420).collect()}
    assert scan == {"minerals": 1, "gas": 1}
    d = {(r.side, r.unit): (r["count"], r.per_match_mean) for r in losses.death_summary(one.death_events, p, 420, 540).collect()}
    assert d == {("lost", "mutalisk"): (1, 1.0), ("lost", "zergling"): (1, 1.0), ("killed", "marine"): (2, 2.0), ("killed", "medic"): (1, 1.0)}
    rows = scope.scope(one.replays, one.players, player="pbjt")
    ex = losses.pair_losses(one.death_events, rows, 420, 540).first()
    assert ex.lost == {"mutalisk": 1, "zergling": 1} and ex.killed == {"marine": 2, "medic": 1}
    nested = losses.losses_between(one.death_events, scope.targets(one.players, one.replays, player="pbjt"), 0, 10, nested=True).first()
    assert nested.deaths == []


def test_card(one):
    c = cards.match_card(one, player="pbjt").first()
    assert (c.duration, c.map, c.opponent_name, c.opponent_race) == ("15:00", "unknown", "Scan", "terran")
    assert [(a.item, a.time) for a in c.build_anchors] == [("Hatchery", "1:58"), ("Spawning Pool", "2:18"), ("Lair", "3:36"), ("Spire", "4:15")]
    assert [(b.time, b.workers) for b in c.economy_benchmarks] == [("5:00", 24), ("7:00", 31)]
    f = c.combat_summary[0]
    assert (f.window, f.lost, f.killed) == ("7:00-9:00", {"mutalisk": 1, "zergling": 1}, {"marine": 2, "medic": 1})
    assert cards.match_card(one, filename_contains="ONE").count() == 2
    assert cards.match_card(one, filename_contains="two").count() == 0


def test_discovery(spark):
    c = build_corpus(spark, [DISCOVERY])
    p = parts(c, player="pbjt")
    assert [(r.name, r.event_count, r.match_count) for r in discovery.list_items(c.build_order_events, p).collect()] == [
        ("Hatchery", 2, 1), ("Mutalisk", 1, 1), ("Spire", 1, 1)
    ]
    units = discovery.list_units(c.unit_count_samples, c.death_events, parts(c)).collect()
    assert [(r.name, r.unit_count_sample_count, r.death_event_count) for r in units] == [
        ("marine", 1, 1), ("drone", 1, 0), ("mutalisk", 1, 0), ("zergling", 0, 1)
    ]
    summary = {(r.dimension, r.value): r.match_count for r in discovery.corpus_summary(parts(c)).collect()}
    assert summary["map", "unknown"] == 1 and summary["all", "all"] == 1 and summary["players", "all"] == 2
    avail = {r.table_name: r.has_rows for r in discovery.availability(parts(c), {"economy": c.economy_samples, "deaths": c.death_events}).collect()}
    assert avail == {"economy": False, "deaths": True}
    assert scope.scope(c.replays, c.players, map_name="UNKNOWN").count() == 2
    assert [r.name for r in discovery.search_items(c.build_order_events, p, "SPI").collect()] == ["Spire"]


CONSTRAINTS = (
    pattern.EventBefore("muta", Event("mutalisk"), 360),
    pattern.UnitCountAt("count", "Mutalisk", 420, at_least=8),
    pattern.WorkersAt("workers", 300, at_least=24),
    pattern.LossesBetween("deaths", 300, 480, at_most=2),
    pattern.EventBeforeEvent("order", Event("Spire"), Event("Hatchery", 2)),
    pattern.EventAfter("vessel", Event("science vessel", side="enemy"), 659),
)
EVIDENCE = (
    pattern.ShowUnitCount("n", "mutalisk", 420),
    pattern.ShowLosses("lost", 300, 480, summaries=pattern.SUMMARIES),
    pattern.ShowEconomyAtEvent("eco", Event("Spire")),
    pattern.ShowUnitCountAtEvent("early", "mutalisk", Event("Hatchery")),
    pattern.ShowEvent("ev", Event("Mutalisk")),
)


def test_plan(two):
    out = pattern.pattern_search(two, player="PBJT", matchup="ZvT", constraints=CONSTRAINTS, evidence=EVIDENCE)
    rows = out.collect()
    assert [r.replay_id for r in rows] == ["replay-match"]
    r = rows[0]
    assert (r.self_player_name, r.self_owner, r.enemy_player_name, r.enemy_owner) == ("pbjt", 3, "Scan", 5)
    assert r.e_n["count"] == 9 and r.e_ev.supply_used == 58
    assert r.e_lost.total_count == 2 and r.e_lost.count_by_unit_type == {"zergling": 1, "mutalisk": 1}
    assert r.e_lost.count_by_category == {"unit": 1, "air": 1} and (r.e_lost.first_time_seconds, r.e_lost.last_time_seconds) == (319.2, 378.0)
    assert (r.e_eco.event.time_seconds, r.e_eco.sample.time_seconds, r.e_eco.sample.workers) == (235, 234.948, 18)
    assert r.e_early.event.time_seconds == 200 and r.e_early.sample is None
    assert (r.v_order.left_event.time_seconds, r.v_order.right_event.time_seconds) == (235, 380)
    raw = pattern.evidence_losses(two, out, EVIDENCE[1], player="pbjt")
    assert sorted(x.unit_type for x in raw.collect()) == ["mutalisk", "zergling"]


def test_plan_debug_and_nulls(two):
    out = {r.replay_id: r for r in pattern.pattern_search(two, player="pbjt", constraints=CONSTRAINTS, evidence=EVIDENCE, debug=True).collect()}
    bad = out["replay-reject"]
    assert not bad.matched and not bad.c_muta and not bad.c_count and not bad.c_workers and bad.c_deaths and bad.c_order and bad.c_vessel
    assert bad.e_n is None and bad.v_workers.workers is None and bad.v_workers.time_seconds == 299.964
    assert out["replay-match"].matched
    early = pattern.pattern_search(two, player="pbjt", constraints=(pattern.UnitCountAt("c", "mutalisk", 1, at_most=99),), debug=True)
    assert all(not r.matched and r.v_c is None for r in early.collect())
    none = pattern.pattern_search(two, player="pbjt", constraints=(pattern.LossesBetween("d", 1, 2, at_most=0),))
    assert none.count() == 2


def test_plan_arguments(two):
    with pytest.raises(ValueError, match="duplicate"):
        pattern.pattern_search(two, player="x", constraints=(CONSTRAINTS[0], CONSTRAINTS[0]))
    with pytest.raises(ValueError, match="lo must"):
        pattern.pattern_search(two, player="x", constraints=(pattern.LossesBetween("a", 2, 1, at_least=1),))
    with pytest.raises(ValueError, match="side"):
        pattern.pattern_search(two, player="x", evidence=(pattern.ShowEconomy("a", 1, side="both"),))


def test_fused_equals_single_facts(two):
    fused = pattern.pattern_search(two, player="pbjt", constraints=CONSTRAINTS, debug=True)
    merged = {r.replay_id: r for r in fused.collect()}
    for c in CONSTRAINTS:
        for r in pattern.pattern_search(two, player="pbjt", constraints=(c,), debug=True).collect():
            assert getattr(r, f"c_{c.id}") == getattr(merged[r.replay_id], f"c_{c.id}")
            assert getattr(r, f"v_{c.id}") == getattr(merged[r.replay_id], f"v_{c.id}")


def test_candidates(two):
    rows = pattern.find_candidates(
        two, player="pbjt", item_a="Mutalisk", before_a=360, item_b="Science Vessel", before_b=700, unit="mutalisk",
        count_at=420, economy_at=300, lo=300, hi=480,
    ).collect()
    assert [r.replay_id for r in rows] == ["replay-match"]
    r = rows[0]
    assert (r.enemy_name, r.enemy_owner, r.count_at["count"], r.economy_at.workers) == ("Scan", 5, 9, 24)
    assert r.self_losses.count_by_unit_type == {"zergling": 1, "mutalisk": 1} and r.enemy_losses.count_by_unit_type == {"marine": 1}


def test_more_than_two_and_single(spark):
    three = {"replay_id": "m3", "matchup": "ZvTvP", "players": [
        {"owner": i, "name": n, "race": r, "events": [(10 * i, "Pylon")], "deaths": [(5, "unit", "unit")]}
        for i, n, r in ((1, "A", "zerg"), (2, "B", "terran"), (4, "a", "protoss"))
    ]}
    single = {"replay_id": "m1", "matchup": "Z", "players": [{"owner": 7, "name": "A", "race": "zerg", "events": [(3, "Pylon")]}]}
    c = build_corpus(spark, [three, single])
    assert scope.scope(c.replays, c.players).count() == 7
    assert scope.scope(c.replays, c.players, dedupe=True).count() == 4
    weights = {(r.replay_id, r.owner): (r.as_self, r.as_opponent) for r in parts(c).collect()}
    assert weights == {("m3", 1): (2, 2), ("m3", 2): (2, 2), ("m3", 4): (2, 2), ("m1", 7): (1, 0)}
    assert events.event_timing_distribution(c.build_order_events, parts(c), "pylon").first().sample_size == 7
    who = {r.replay_id: r for r in scope.identity(c.players, "a").collect()}
    assert who["m3"].self_owner is None and who["m1"].self_owner == 7 and who["m1"].enemy_owner is None
    p = {r.replay_id: r for r in scope.perspective(c.players, player="A").collect()}
    assert (p["m3"].self_owner, p["m3"].enemy_owner) == (1, 2) and p["m1"].enemy_owner is None
    last = {r.replay_id: r for r in scope.perspective(c.players, player="A", last=True).collect()}
    assert (last["m3"].self_owner, last["m3"].enemy_owner) == (4, 2)
    only = pattern.pattern_search(c, player="A", evidence=(pattern.ShowEconomyAtEvent("e", Event("pylon")),)).collect()
    assert {r.replay_id for r in only} == {"m3", "m1"}
    empty = build_corpus(spark, [])
    assert events.event_timing_distribution(empty.build_order_events, parts(empty), "x").first().sample_size == 0
    assert losses.death_summary(empty.death_events, parts(empty), 0, 1).count() == 0


def test_combat(spark):
    catalog = spark.createDataFrame(
        [("Mutalisk", "Zerg", "Unit", 1.0, 100, 100, 1.0, "Larva"), ("Drone", "Zerg", "Unit", 1.0, 50, 0, 1.0, "Larva"),
         ("Hatchery", "Zerg", "Building", 75.0, 300, 0, 0.0, "Drone")], CATALOG)
    m = {"replay_id": "r", "players": [
        {"owner": 1, "name": "A", "race": "Zerg", "events": [(100, "hatchery"), (100.5, "Hatchery"), (300, "Hatchery")],
         "deaths": [(100.9, "drone", "worker"), (101.4, "drone", "worker"), (301.5, "drone", "worker"), (400, "mutalisk", "air"), (400, "critter", "other")]},
        {"owner": 2, "name": "B", "race": "terran", "deaths": [(185, "marine", "unit")] + [(600 + i * 0.5, u, k) for i, (u, k) in enumerate(
            [("marine", "unit"), ("scv", "worker"), ("barracks", "building")] * 3)]},
    ]}
    c = build_corpus(spark, [m], catalog)
    deaths = c.death_events.withColumn("death_id", F.monotonically_increasing_id())
    kinds = [(r.time_seconds, r.kind) for r in combat.classify_losses(deaths, c.build_order_events, c.players, catalog).orderBy("owner", "time_seconds").collect()]
    assert [k for _, k in kinds[:3]] == ["construction", "construction", "combat"]
    assert [k for t, k in kinds if t >= 600] == ["terminal"] * 9
    trade = {r.owner: r for r in combat.resource_trade(combat.combat_events(c.death_events, catalog)).collect()}
    assert (trade[1].own_losses, trade[1].own_minerals, trade[1].own_gas, trade[1].enemy_losses) == (4, 250, 100, 10)
    assert {r.display_name for r in combat.unknown_cost_units(combat.combat_events(c.death_events, catalog)).collect()} == {"Marine", "Scv", "Barracks"}
    cps = {r.checkpoint for r in combat.loss_checkpoints(combat.combat_events(c.death_events, catalog)).collect()}
    assert cps == {180, 240, 360, 420, 600, 720}
    seen = combat.seen_from(combat.combat_events(c.death_events, catalog).where("time_seconds < 200 or time_seconds = 600"), c.players)
    ordered = [(r.time_seconds, r.side) for r in combat.in_combat_order(seen.where("self_owner = 1")).collect()]
    assert ordered == [(100.9, "own"), (101.4, "own"), (185.0, "enemy"), (600.0, "enemy")]
    ledger = combat.combat_ledger(combat.combat_events(c.death_events, catalog), c.players)
    own = [r for r in ledger["milestones"].collect() if r.self_owner == 1 and r.side == "own"]
    assert {(r.kind, r.label, r.n) for r in own} == {("unit", "drone", 1), ("unit", "drone", 2), ("unit", "mutalisk", 1), ("category", "worker", 1)}


@pytest.mark.parametrize("tail, other, dropped", [(7, 0, False), (8, 0, True), (8, 32, True), (8, 33, False)])
def test_trim_edges(spark, tail, other, dropped):
    cats = ["worker", "unit", "building"]
    rows = [("r", 1, float(i % 50), cats[i % 3]) for i in range(other)] + [("r", 1, 100.0 + i * 0.5, cats[i % 3]) for i in range(tail)]
    df = spark.createDataFrame(rows, "replay_id string, owner int, time_seconds double, category string")
    assert combat.trim_end(df).count() == (other if dropped else other + tail)


def test_text(spark):
    def one(col):
        return spark.range(1).select(col.alias("x")).first().x

    assert [one(text.clock(F.lit(v))) for v in (0.0, 255.0, 255.4, 59.5, -3.0)] == ["0:00", "4:15", "4:15", "1:00", "0:00"]
    assert one(text.clock(F.lit(None))) == "unknown" and one(text.clock(F.lit(float("inf")))) == "unknown"
    assert one(text.padded_clock(F.lit(255.9))) == "04:15" and one(text.padded_clock(F.lit(None))) == "" and one(text.padded_clock(F.lit(6000.0))) == "100:00"
    assert one(text.normalize_key(F.lit("  Queen's  Nest! "))) == "queen_s_nest"
    assert [one(text.display_name(F.lit(v))) for v in ("scv", "emp_shockwave", "u_238_shells", "science_vessel", "mark_ii")] == [
        "SCV", "EMP Shockwave", "U-238 Shells", "Science Vessel", "Mark II"]
    assert one(text.titleize(F.lit("_siege__tank"))) == "Siege Tank"
    assert one(text.ascii_lower(F.lit("ÀZÉ"))) == "ÀzÉ"
    assert [one(text.unit_race(F.lit(n), F.lit(i))) for n, i in (("valkyrie", 58), ("x", 107), ("protoss_x", 1), ("x", 300))] == ["zerg", "terran", "protoss", None]
    assert [one(text.supply_state(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 0), (10, 10), (9, 10), (8, 10))] == ["zero", "over", "capped", "warn", "ok"]
    flags = {n for n, c in text.decode_flags(F.lit(0b10000000101)).items() if one(c)}
    assert flags == {"completed", "morphing_building", "lifted"}
    two = F.array(F.struct(F.lit(5).alias("owner"), F.lit("terran").alias("race")), F.struct(F.lit(3).alias("owner"), F.lit("zerg").alias("race")))
    assert one(text.matchup_text(two)) == "ZvT" and one(text.matchup_or_null(two)) == "ZvT"


def test_features(one):
    assert [len(features.feature_names(r)) for r in ("zerg", "protoss", "terran")] == [186, 234, 249] and len(features.global_features()) == 53
    m = features.feature_matrix(one, "zerg")
    assert len(m.columns) == 4 + 53 + 186 and set(features.global_features() + features.feature_names("zerg")) <= set(m.columns)
    r = m.first()
    assert (r.opponent_race, r.worker_count_at_5m, r.worker_count_at_7m, r.mutalisk_count_at_7m, r.mutalisk_count_at_6m) == ("terran", 24, 31, 8, None)
    assert (r.time_first_started_spire_s, r.time_second_started_hatchery_s, r.time_research_started_hatchery_lair_s) == (255, None, 216)
    assert r.spawn_position_relation is None and r.time_first_started_overlord_s is None


def test_sql(spark, one):
    one.create_views()
    rows, cols, cut = bounded_sql(spark, "SELECT item FROM build_order_events WHERE owner = ? ORDER BY time_seconds;", [3], 2)
    assert cols == ["item"] and [r.item for r in rows] == ["Hatchery", "Spawning Pool"] and cut
    rows, _, cut = bounded_sql(spark, "WITH x AS (SELECT 1 AS a) -- note\n SELECT * FROM x WHERE a = ?", [True])
    assert [r.a for r in rows] == [1] and not cut
    for bad in ("DROP TABLE replays", "SELECT 1; SELECT 2", "INSERT INTO replays SELECT 1", "SET x = 1", "CREATE VIEW v AS SELECT 1", "", "SELECT 1) AS q; DROP VIEW replays --"):
        with pytest.raises(Exception):
            bounded_sql(spark, bad)
    with pytest.raises(ValueError):
        bounded_sql(spark, "SELECT ?", [float("nan")])
    assert len(bounded_sql(spark, "SELECT id FROM range(2000)", max_rows=9999)[0]) == 500
    for bad in ("SELECT reflect('java.lang.System', 'nanoTime')", "SELECT * FROM parquet.`/tmp/x`", "SELECT java_method ('a', 'b')"):
        with pytest.raises(ValueError, match="corpus views"):
            bounded_sql(spark, bad)
    assert bounded_sql(spark, "SELECT 'reflect(' AS a")[0][0].a == "reflect("


HIDDEN = r"""SELECT reflect/**/('java.lang.System', 'getProperty', 'java.version')
SELECT `reflect`('java.lang.System', 'getProperty', 'java.version')
SELECT 1 -- it's\n, reflect('java.lang.System', 'getProperty', 'java.version')
SELECT * FROM parquet/**/.`/tmp/x`
SELECT 1) AS q UNION ALL SELECT * FROM (SELECT 2
SELECT * FROM replays WHERE EXISTS (SELECT try_reflect('a', 'b'))
SELECT item FROM (SELECT * FROM build_order_events) WHERE owner IN (SELECT id FROM secret)
SELECT count(*) OVER w FROM replays WINDOW w AS (PARTITION BY java_method('java.lang.System', 'nanoTime'))
WITH a AS (SELECT * FROM secret) SELECT * FROM a
SELECT * FROM (WITH secret AS (SELECT 1 AS b) SELECT * FROM secret), secret
WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS c) SELECT * FROM a
SELECT * FROM IDENTIFIER('secret')
SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')
SELECT TRANSFORM(item) USING 'cat' AS (x) FROM build_order_events
SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))
SELECT max(reflect('java.lang.System', 'nanoTime')) FROM replays HAVING count(*) > 0
SELECT * FROM replays ORDER BY reflect('java.lang.System', 'nanoTime')
SELECT * FROM replays, LATERAL (SELECT reflect('java.lang.System', 'nanoTime') AS r)
SELECT own(item) FROM build_order_events
SELECT x FROM replays LATERAL VIEW own(1) e AS x
SELECT spark_catalog.default.own(1)
SELECT * FROM spark_catalog.default.replays
SELECT current_user()
FROM replays INSERT INTO x SELECT *
EXPLAIN SELECT 1
SHOW TABLES
CACHE TABLE replays
BEGIN SELECT 1; END"""


def test_sql_guard_reads_the_plan(spark, one):
    one.create_views()
    spark.range(1).createOrReplaceTempView("secret")
    spark.udf.register("own", lambda x: x)
    for bad in HIDDEN.splitlines():
        with pytest.raises(Exception) as seen:
            bounded_sql(spark, bad.replace("\\n", "\n"))
        assert isinstance(seen.value, ValueError) or "PARSE" in str(seen.value), bad
    fine = """WITH a AS (SELECT owner, item, count(*) AS n FROM build_order_events GROUP BY owner, item), b AS (SELECT * FROM a WHERE n > 0)
SELECT upper(item) AS i, row_number() OVER (PARTITION BY owner ORDER BY n, item) AS r, transform(array(1, 2), x -> x + n) AS t,
 CASE WHEN EXISTS (SELECT 1 FROM replays WHERE duration_seconds > ?) THEN 'reflect(' ELSE "it's" END AS c
FROM b JOIN players USING (owner) WHERE item IN (SELECT item FROM build_order_events) /* reflect('a') */ ORDER BY i LIMIT 10 -- java_method('"""
    assert bounded_sql(spark, fine, [0])[0]
    assert bounded_sql(spark, "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)")[0][1].y == "b"
    assert bounded_sql(spark, "SELECT x FROM replays LATERAL VIEW explode(array(1, 2)) e AS x UNION SELECT 3")[1] == ["x"]
    rows, _, cut = bounded_sql(spark, "SELECT id FROM range(5)", max_rows=4)
    assert len(rows) == 4 and cut


def test_starters(one):
    for report in STARTERS.values():
        whole = report(one).collect()
        assert report(one, limit=1).collect() == whole[:1]
    assert STARTERS["nth_occurrence"](one, item="sPAWNING pool", n=1).count() == STARTERS["nth_occurrence"](one, item="Spawning Pool", n=1).count() > 0


def test_quality(spark, one):
    assert {r.orphan_rows for r in quality.corpus_orphans(one).collect()} == {0}
    lost = quality.orphans({"deaths": one.death_events}, one.players.where("owner = 3")).first()
    assert lost.orphan_rows == 3
