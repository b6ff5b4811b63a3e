"""Queries for loss analytics, intervals, pattern search, cards and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards, changes, combat, features, intervals, pattern
from ..operators.pattern import Event
from .adapters import Tables
from .event_queries import PLAYER, clock_sql
from .registry import query

K = ["replay_id", "owner"]


def _combat(t: Tables) -> DataFrame:
    return combat.combat_events(t.corpus.death_events, t.catalog)


TOTALS = """count(*) AS losses, CAST(coalesce(sum(minerals) FILTER (known_cost), 0) AS BIGINT) AS minerals,
CAST(coalesce(sum(gas) FILTER (known_cost), 0) AS BIGINT) AS gas"""


@query(
    base="m",
    sql=f"""
WITH own AS (SELECT replay_id, owner, {TOTALS} FROM combat GROUP BY ALL),
tot AS (SELECT replay_id, sum(losses) AS l, sum(minerals) AS m, sum(gas) AS g FROM own GROUP BY ALL)
SELECT replay_id, owner, losses AS own_losses, minerals AS own_minerals, gas AS own_gas, CAST(l - losses AS BIGINT) AS enemy_losses,
 CAST(m - minerals AS BIGINT) AS enemy_minerals, CAST(g - gas AS BIGINT) AS enemy_gas FROM own JOIN tot USING (replay_id)""",
)
def resource_trade(t: Tables) -> DataFrame:
    return combat.resource_trade(_combat(t))


@query(base="m", sql=f"SELECT replay_id, owner, unit_key, {TOTALS} FROM combat WHERE time_seconds <= 900 GROUP BY ALL")
def cumulative_losses(t: Tables) -> DataFrame:
    return combat.cumulative_losses(_combat(t), 900)


@query(base="m", sql="SELECT DISTINCT replay_id, display_name FROM combat WHERE NOT known_cost")
def unknown_cost_units(t: Tables) -> DataFrame:
    return combat.unknown_cost_units(_combat(t))


SESSION = """
WITH p AS (SELECT *, time_seconds - lag(time_seconds) OVER (PARTITION BY {k} ORDER BY time_seconds) AS d FROM {f}),
n AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY time_seconds) AS session FROM p)
"""


@query(
    base="m",
    sql=SESSION.format(k="replay_id", f="combat", g="30")
    + f"SELECT replay_id, CAST(session AS BIGINT) AS session, min(time_seconds) AS session_start, max(time_seconds) AS session_end, {TOTALS} FROM n GROUP BY ALL",
)
def loss_sessions(t: Tables) -> DataFrame:
    return combat.loss_sessions(_combat(t), gap=30)


@query(
    base="m",
    sql=SESSION.format(k="replay_id", f="combat", g="30")
    + f"SELECT replay_id, CAST(session AS BIGINT) AS session, owner, unit_key, {TOTALS} FROM n GROUP BY ALL",
)
def session_units(t: Tables) -> DataFrame:
    return combat.session_units(_combat(t), gap=30)


@query(
    base="e",
    sql=SESSION.format(k="user_id", f="ev", g="3600")
    + "SELECT user_id, CAST(session AS BIGINT) AS session, min(time_seconds) AS session_start, max(time_seconds) AS session_end, count(*) AS event_count FROM n GROUP BY ALL",
)
def event_sessions(t: Tables) -> DataFrame:
    return combat.loss_sessions(
        t.events, ["user_id"], 3600, order=("event_id",), measures=[F.count(F.lit(1)).alias("event_count")]
    )


@query(
    base="m",
    sql=f"""
WITH cp AS (SELECT unnest([180, 240, 300, 360, 420, 480, 600, 720]) AS checkpoint),
live AS (SELECT replay_id, checkpoint, count(*) AS n FROM combat JOIN cp ON time_seconds <= checkpoint GROUP BY ALL),
kept AS (SELECT replay_id, checkpoint FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY replay_id ORDER BY checkpoint) AS before FROM live) WHERE n <> before)
SELECT c.replay_id, c.owner, k.checkpoint, unit_key, {TOTALS} FROM combat c JOIN kept k ON k.replay_id = c.replay_id AND time_seconds <= k.checkpoint GROUP BY ALL""",
)
def loss_checkpoints(t: Tables) -> DataFrame:
    return combat.loss_checkpoints(_combat(t))


@query(
    base="m",
    sql="""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY replay_id, owner, unit_key ORDER BY time_seconds, display_name, frame) AS n FROM combat),
c AS (SELECT *, row_number() OVER (PARTITION BY replay_id, owner, category ORDER BY time_seconds, display_name, frame) AS n FROM combat WHERE category IN ('worker', 'unit', 'building'))
SELECT replay_id, owner, time_seconds, unit_key, display_name, category, 'unit' AS kind, unit_key AS label, n FROM u WHERE n = 1 OR (unit_key IN ('large', 'small') AND n IN (2, 5, 10))
UNION ALL SELECT replay_id, owner, time_seconds, unit_key, display_name, category, 'category', CASE category WHEN 'unit' THEN 'army' ELSE category END, n FROM c WHERE n = 1""",
)
def loss_milestones(t: Tables) -> DataFrame:
    return combat.loss_milestones(_combat(t), strategic=("large", "small"))


@query(
    base="m",
    sql="""
WITH v AS (SELECT c.*, p.owner AS self_owner, CASE WHEN c.owner = p.owner THEN 'own' ELSE 'enemy' END AS side FROM combat c JOIN players p USING (replay_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY replay_id, self_owner, side, unit_key ORDER BY time_seconds, display_name, frame) AS n FROM v),
c AS (SELECT *, row_number() OVER (PARTITION BY replay_id, self_owner, side, category ORDER BY time_seconds, display_name, frame) AS n FROM v WHERE category IN ('worker', 'unit', 'building'))
SELECT replay_id, self_owner, side, time_seconds, 'unit' AS kind, unit_key AS label, n FROM u WHERE n = 1 OR (unit_key IN ('large', 'small') AND n IN (2, 5, 10))
UNION ALL SELECT replay_id, self_owner, side, time_seconds, 'category', CASE category WHEN 'unit' THEN 'army' ELSE category END, n FROM c WHERE n = 1""",
)
def milestones_both_sides(t: Tables) -> DataFrame:
    out = combat.seen_milestones(_combat(t), t.corpus.players, strategic=("large", "small"))
    return out.select("replay_id", "self_owner", "side", "time_seconds", "kind", "label", "n")


@query(
    base="m",
    sql="""
WITH b AS (SELECT replay_id, owner, lane, CAST(floor(time_seconds / 5) AS BIGINT) AS bucket, count(*) AS losses FROM combat GROUP BY ALL)
SELECT *, (SELECT greatest(1, max(losses)) FROM b) AS max_losses FROM b""",
)
def loss_heatmap(t: Tables) -> DataFrame:
    return combat.loss_heatmap(_combat(t))


@query(base="m", sql="SELECT replay_id, owner, lane, CAST(floor(time_seconds / 5) AS BIGINT) AS bucket, unit_key, count(*) AS losses FROM combat GROUP BY ALL")
def heatmap_details(t: Tables) -> DataFrame:
    return combat.heatmap_details(_combat(t))


def _supplier_deaths(t: Tables) -> DataFrame:
    """All lines of a supplier in a month-long match, so that ends are crowded."""
    n = F.col("l_linenumber")
    category = F.when(n == 1, "worker").when(n == 2, "building").when(n == 4, "resource").otherwise("unit")
    month = F.floor(F.col("time_seconds") / 60)
    return t.lines.select(
        F.col("owner").alias("replay_id"), month.alias("owner"), "time_seconds", category.alias("category"),
        (F.col("replay_id") * 100_000_000 + F.col("seq")).alias("death_id"),
    )


@query(
    base="m",
    sql="""
WITH d AS (SELECT owner AS replay_id, CAST(floor(time_seconds / 60) AS BIGINT) AS owner, time_seconds, replay_id * 100000000 + seq AS death_id,
  CASE l_linenumber WHEN 1 THEN 'w' WHEN 2 THEN 'b' WHEN 4 THEN NULL ELSE 'u' END AS lane FROM lines),
e AS (SELECT replay_id, owner, max(time_seconds) AS end_t, count(*) AS n FROM d GROUP BY ALL),
tail AS (SELECT d.replay_id, d.owner, end_t, n, count(lane) AS k, count(DISTINCT lane) AS lanes FROM d JOIN e USING (replay_id, owner) WHERE end_t - time_seconds <= 5 GROUP BY ALL),
cut AS (SELECT replay_id, owner, end_t FROM tail WHERE n >= 8 AND k >= 8 AND k / n >= 0.2 AND lanes = 3)
SELECT d.replay_id, d.owner, count(*) AS kept FROM d LEFT JOIN cut USING (replay_id, owner) WHERE end_t IS NULL OR end_t - time_seconds > 5 GROUP BY ALL""",
)
def terminal_trim(t: Tables) -> DataFrame:
    return combat.trim_end(_supplier_deaths(t)).groupBy(*K).agg(F.count(F.lit(1)).alias("kept"))


# Supply states per supplier, where samples are dense enough to form intervals.

def _supplier_supply(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = F.col("l_quantity").cast("int")
    supply = t.lines.select(
        F.col("owner").alias("replay_id"), F.lit(0).alias("owner"), "time_seconds",
        q.alias("current"), F.when(F.col("l_tax") == 0, 0).otherwise(40).alias("max"),
        (F.col("replay_id") * 100_000_000 + F.col("seq")).alias("frame"),
    )
    ranges = t.read("supplier").select(
        F.col("s_suppkey").alias("replay_id"), F.lit(0.0).alias("range_min"), F.lit(2400.0).alias("range_max")
    )
    return supply, ranges


@query(
    base="m",
    sql="""
WITH s AS (SELECT owner AS k, time_seconds AS t, CAST(l_quantity AS INT) AS cur, CASE WHEN l_tax = 0 THEN 0 ELSE 40 END AS mx, replay_id * 100000000 + seq AS f FROM lines),
pts AS (
 SELECT k, 0.0 AS t, -1 AS f, CASE WHEN min(t) >= 0 THEN arg_min(cur, (t, f)) END AS cur, arg_min(mx, (t, f)) AS mx FROM s GROUP BY k
 UNION ALL SELECT k, t, f, cur, mx FROM s WHERE t > 0 AND t < 2400),
st AS (SELECT k, t, f, CASE WHEN mx = 0 AND cur > 0 THEN 'over' WHEN mx = 0 THEN 'zero' WHEN cur >= mx THEN 'capped' WHEN cur / mx >= 0.9 THEN 'warn' ELSE 'ok' END AS state,
   lead(t, 1, 2400) OVER (PARTITION BY k ORDER BY t, f) AS e FROM pts),
raw AS (SELECT k, t AS s, e, state FROM st WHERE e > t),
g1 AS (SELECT *, sum(CASE WHEN state = prev THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY k ORDER BY s) AS prev FROM raw)),
m1 AS (SELECT k, g, min(s) AS s, max(e) AS e, any_value(state) AS state FROM g1 GROUP BY k, g),
nb AS (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS n FROM m1 WINDOW w AS (PARTITION BY k ORDER BY s)),
sev AS (SELECT *, CASE p WHEN 'over' THEN 3 WHEN 'capped' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS sp, CASE n WHEN 'over' THEN 3 WHEN 'capped' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS sn FROM nb),
ab AS (SELECT k, s, e, CASE WHEN state = 'ok' AND e - s <= 5 AND sp > 0 AND sn > 0 THEN CASE WHEN sp >= sn THEN p ELSE n END ELSE state END AS state FROM sev),
g2 AS (SELECT *, sum(CASE WHEN state = prev THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s) AS g FROM (SELECT *, lag(state) OVER (PARTITION BY k ORDER BY s) AS prev FROM ab))
SELECT k AS replay_id, CAST(min(s) AS DOUBLE) AS start, CAST(max(e) AS DOUBLE) AS "end", any_value(state) AS state FROM g2 GROUP BY k, g""",
)
def supply_intervals(t: Tables) -> DataFrame:
    supply, ranges = _supplier_supply(t)
    return intervals.supply_intervals(supply, ranges).select("replay_id", "start", "end", "state")


@query(
    base="m",
    sql="""
WITH a AS (SELECT replay_id, max(time_seconds + 10) AS hi FROM build_order_events GROUP BY ALL), b AS (SELECT replay_id, max(time_seconds) AS hi FROM supply_samples GROUP BY ALL)
SELECT r.replay_id, CAST(0.0 AS DOUBLE) AS range_min, greatest(300.0, coalesce(greatest(a.hi, b.hi), 0) + 120) AS range_max FROM replays r LEFT JOIN a USING (replay_id) LEFT JOIN b USING (replay_id)""",
)
def timeline_extent(t: Tables) -> DataFrame:
    c = t.corpus
    return intervals.extent(c.replays, c.build_order_events.withColumn("bt", F.lit(10.0)), [c.supply_samples], build_time="bt")


@query(
    base="m",
    sql="""
WITH s AS (SELECT owner AS k, time_seconds AS t, replay_id * 100000000 + seq AS f, CAST(floor(l_quantity / 20) AS BIGINT) AS v FROM lines)
SELECT k, t, f, v FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY t, f) AS p FROM s) WHERE p IS NULL OR p <> v""",
)
def change_only_compaction(t: Tables) -> DataFrame:
    rows = t.lines.select(
        F.col("owner").alias("k"), F.col("time_seconds").alias("t"),
        (F.col("replay_id") * 100_000_000 + F.col("seq")).alias("f"), F.floor(F.col("l_quantity") / 20).alias("v"),
    )
    return changes.compact_changes(rows, ["k"], ["t", "f"], F.col("v"))


@query(
    sql="""
SELECT source, doc_id, CASE WHEN n = 1 THEN source ELSE source || '_' || n END AS unique_name FROM
 (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)"""
)
def unique_names(t: Tables) -> DataFrame:
    rows = t.read("documents").select("source", "doc_id")
    return changes.unique_names(rows, "source", ["doc_id"])


@query(
    sql="""
SELECT event_id, value, CAST(props->>'k' AS DOUBLE) AS k FROM events WHERE value IS NOT NULL"""
)
def clean_samples(t: Tables) -> DataFrame:
    rows = t.read("events").select("event_id", "value", F.get_json_object("props", "$.k").alias("k"))
    return changes.clean_series(rows, ["value"], ["k"])


# Pattern search.

CONSTRAINTS = (
    pattern.EventBefore("early_economy", Event("economy"), 1800),
    pattern.EventAfter("late_promo", Event("promo", side="enemy"), 100),
    pattern.WorkersAt("workers", 1500, at_least=5),
    pattern.LossesBetween("few_losses", 0, 600, at_most=1),
)
PLAN = f"""
WITH cnt AS (SELECT replay_id, count(*) AS n FROM players GROUP BY ALL),
me AS (SELECT replay_id, min(owner) AS s, count(*) AS c FROM players WHERE name = '{PLAYER}' GROUP BY ALL),
base AS (SELECT r.replay_id, r.matchup, me.s, c, (SELECT min(owner) FROM players p WHERE p.replay_id = r.replay_id AND p.owner <> me.s) AS e, n
  FROM replays r JOIN me USING (replay_id) JOIN cnt USING (replay_id)),
ev1 AS (SELECT replay_id, owner, item, min(time_seconds) AS t FROM build_order_events GROUP BY ALL),
eco AS (SELECT replay_id, owner, time_seconds, workers, minerals, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds DESC, frame DESC) AS rn FROM economy_samples WHERE time_seconds <= 1500),
uc AS (SELECT replay_id, owner, count, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds DESC, frame DESC) AS rn FROM unit_count_samples WHERE time_seconds <= 2000 AND unit_type = 'LARGE'),
de AS (SELECT replay_id, owner, count(*) FILTER (time_seconds BETWEEN 0 AND 600) AS n6, count(*) FILTER (time_seconds BETWEEN 0 AND 3000) AS n30 FROM death_events GROUP BY ALL),
facts AS (
 SELECT b.*, a.t AS t_eco, p.t AS t_promo, eco.workers AS w, eco.minerals AS minerals, eco.time_seconds AS eco_t, coalesce(d.n6, 0) AS n6, coalesce(de2.n30, 0) AS enemy_losses, uc.count AS large_count
 FROM base b LEFT JOIN ev1 a ON a.replay_id = b.replay_id AND a.owner = b.s AND a.item = 'ECONOMY'
 LEFT JOIN ev1 p ON p.replay_id = b.replay_id AND p.owner = b.e AND p.item = 'PROMO'
 LEFT JOIN eco ON eco.replay_id = b.replay_id AND eco.owner = b.s AND eco.rn = 1
 LEFT JOIN uc ON uc.replay_id = b.replay_id AND uc.owner = b.e AND uc.rn = 1
 LEFT JOIN de d ON d.replay_id = b.replay_id AND d.owner = b.s
 LEFT JOIN de de2 ON de2.replay_id = b.replay_id AND de2.owner = b.e),
judged AS (SELECT *, coalesce(t_eco < 1800, false) AS c_early_economy, coalesce(t_promo > 100, false) AS c_late_promo, coalesce(w >= 5, false) AS c_workers, n6 <= 1 AS c_few_losses FROM facts)
"""
EVIDENCE = (
    pattern.ShowUnitCount("large", "LARGE", 2000, side="enemy"),
    pattern.ShowEconomy("eco", 1500),
    pattern.ShowLosses("losses", 0, 3000, side="enemy"),
)


@query(
    base="m",
    sql=PLAN + """
SELECT replay_id, matchup, CASE WHEN c = 1 THEN s END AS self_owner, CASE WHEN c = 1 AND n = 2 THEN e END AS enemy_owner, t_eco, t_promo, w AS workers,
 large_count, minerals, enemy_losses FROM judged WHERE c_early_economy AND c_late_promo AND c_workers AND c_few_losses""",
)
def plan_match(t: Tables) -> DataFrame:
    out = pattern.pattern_search(t.corpus, player=PLAYER, constraints=CONSTRAINTS, evidence=EVIDENCE)
    return out.select(
        "replay_id", "matchup", "self_owner", "enemy_owner",
        F.col("v_early_economy.time_seconds").alias("t_eco"), F.col("v_late_promo.time_seconds").alias("t_promo"),
        F.col("v_workers.workers").alias("workers"), F.col("e_large.count").alias("large_count"),
        F.col("e_eco.minerals").alias("minerals"), F.col("e_losses.total_count").alias("enemy_losses"),
    )


@query(
    base="m",
    sql=PLAN + """
SELECT replay_id, c_early_economy, c_late_promo, c_workers, c_few_losses, n6, c_early_economy AND c_late_promo AND c_workers AND c_few_losses AS matched,
 CASE WHEN c_early_economy AND c_late_promo AND c_workers AND c_few_losses THEN enemy_losses END AS enemy_losses FROM judged""",
)
def plan_debug(t: Tables) -> DataFrame:
    out = pattern.pattern_search(t.corpus, player=PLAYER, constraints=CONSTRAINTS, evidence=EVIDENCE, debug=True)
    return out.select(
        "replay_id", *[f"c_{c.id}" for c in CONSTRAINTS], F.col("v_few_losses").alias("n6"), "matched",
        F.col("e_losses.total_count").alias("enemy_losses"),
    )


@query(
    base="m",
    sql=f"""
WITH cnt AS (SELECT replay_id, count(*) AS n FROM players GROUP BY ALL),
me AS (SELECT replay_id, min(owner) AS s, count(*) AS c FROM players WHERE name = '{PLAYER}' GROUP BY ALL),
base AS (SELECT me.*, n, (SELECT min(owner) FROM players p WHERE p.replay_id = me.replay_id AND p.owner <> me.s) AS e FROM me JOIN cnt USING (replay_id)),
second AS (SELECT replay_id, owner, time_seconds AS t FROM (SELECT *, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item = 'LARGE') WHERE n = 1),
j AS (SELECT b.*, a.t AS ta, z.t AS tz FROM base b LEFT JOIN second a ON a.replay_id = b.replay_id AND a.owner = b.s LEFT JOIN second z ON z.replay_id = b.replay_id AND z.owner = b.e),
eco AS (SELECT j.replay_id, arg_max(s.minerals, (s.time_seconds, s.frame)) AS m FROM j JOIN economy_samples s ON s.replay_id = j.replay_id AND s.owner = j.s AND s.time_seconds <= j.tz WHERE j.c = 1 GROUP BY ALL),
uc AS (SELECT j.replay_id, arg_max(s.count, (s.time_seconds, s.frame)) AS k FROM j JOIN unit_count_samples s ON s.replay_id = j.replay_id AND s.owner = j.e AND s.unit_type = 'SMALL' AND s.time_seconds <= j.ta WHERE j.n = 2 AND j.c = 1 GROUP BY ALL)
SELECT j.replay_id, tz AS enemy_seconds, m AS minerals, ta AS own_seconds, k AS small_count FROM j LEFT JOIN eco USING (replay_id) LEFT JOIN uc USING (replay_id)""",
)
def plan_event_time_evidence(t: Tables) -> DataFrame:
    out = pattern.pattern_search(
        t.corpus, player=PLAYER,
        evidence=(
            pattern.ShowEconomyAtEvent("eco", Event("large", side="enemy")),
            pattern.ShowUnitCountAtEvent("small", "small", Event("LARGE"), side="enemy"),
        ),
    )
    return out.select(
        "replay_id", F.col("e_eco.event.time_seconds").alias("enemy_seconds"), F.col("e_eco.sample.minerals").alias("minerals"),
        F.col("e_small.event.time_seconds").alias("own_seconds"), F.col("e_small.sample.count").alias("small_count"),
    )


@query(
    base="m",
    sql=f"""
WITH me AS (SELECT replay_id, owner FROM players WHERE name = '{PLAYER}'),
b AS (SELECT me.replay_id, me.owner AS s, (SELECT max(owner) FROM players p WHERE p.replay_id = me.replay_id AND p.owner <> me.owner) AS e FROM me),
f AS (SELECT replay_id, owner, item, min(time_seconds) AS t FROM build_order_events GROUP BY ALL),
uc AS (SELECT replay_id, owner, count, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds DESC, frame DESC) AS rn FROM unit_count_samples WHERE time_seconds <= 1500 AND unit_type = 'ECONOMY'),
ec AS (SELECT replay_id, owner, minerals, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds DESC, frame DESC) AS rn FROM economy_samples WHERE time_seconds <= 1500),
d AS (SELECT replay_id, owner, count(*) AS n FROM death_events WHERE time_seconds BETWEEN 0 AND 2000 GROUP BY ALL)
SELECT b.replay_id, b.s AS player_owner, b.e AS enemy_owner, x.t AS first_a, y.t AS first_b, uc.count AS unit_count, ec.minerals, coalesce(d1.n, 0) AS self_losses, coalesce(d2.n, 0) AS enemy_losses
FROM b JOIN f x ON x.replay_id = b.replay_id AND x.owner = b.s AND x.item = 'ECONOMY' AND x.t < 2000
JOIN f y ON y.replay_id = b.replay_id AND y.owner = b.e AND y.item = 'PROMO' AND y.t < 2300
LEFT JOIN uc ON uc.replay_id = b.replay_id AND uc.owner = b.s AND uc.rn = 1 LEFT JOIN ec ON ec.replay_id = b.replay_id AND ec.owner = b.s AND ec.rn = 1
LEFT JOIN d d1 ON d1.replay_id = b.replay_id AND d1.owner = b.s LEFT JOIN d d2 ON d2.replay_id = b.replay_id AND d2.owner = b.e""",
)
def candidate_finder(t: Tables) -> DataFrame:
    out = pattern.find_candidates(
        t.corpus, player=PLAYER, item_a="Economy", before_a=2000, item_b="Promo", before_b=2300,
        unit="economy", count_at=1500, economy_at=1500, lo=0, hi=2000,
    )
    return out.select(
        "replay_id", "player_owner", "enemy_owner", F.col("first_a.time_seconds").alias("first_a"),
        F.col("first_b.time_seconds").alias("first_b"), F.col("count_at.count").alias("unit_count"),
        F.col("economy_at.minerals").alias("minerals"), F.col("self_losses.total_count").alias("self_losses"),
        F.col("enemy_losses.total_count").alias("enemy_losses"),
    )


ANCHORS = {"nation_1": ("Large", "Promo"), "nation_2": ("Small",)}


@query(
    base="m",
    sql=f"""
WITH o AS (SELECT replay_id, self_owner AS owner, min(opponent_owner) AS opp FROM pairs GROUP BY ALL),
f AS (SELECT replay_id, owner, item, min(time_seconds) AS t FROM build_order_events GROUP BY ALL),
ec AS (SELECT replay_id, owner, workers, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds DESC, frame DESC) AS rn FROM economy_samples WHERE time_seconds <= 420),
d AS (SELECT replay_id, owner, count(*) AS n FROM death_events WHERE time_seconds BETWEEN 420 AND 540 GROUP BY ALL),
a AS (SELECT p.replay_id, p.owner, string_agg(w.shown || '@' || {clock_sql('f.t')}, ',' ORDER BY w.i) AS anchors FROM players p
 JOIN (VALUES ('NATION_1', 'LARGE', 'Large', 1), ('NATION_1', 'PROMO', 'Promo', 2), ('NATION_2', 'SMALL', 'Small', 1)) w(race, item, shown, i) ON w.race = p.race
 JOIN f ON f.replay_id = p.replay_id AND f.owner = p.owner AND f.item = w.item GROUP BY ALL)
SELECT p.replay_id, p.owner, coalesce(r.map, 'unknown') AS map, {clock_sql('r.duration_seconds')} AS duration, o.opp AS opponent_owner, coalesce(a.anchors, '') AS anchors, ec.workers AS workers_420,
 coalesce(d1.n, 0) AS lost, coalesce(d2.n, 0) AS killed
FROM players p JOIN replays r USING (replay_id) JOIN o ON o.replay_id = p.replay_id AND o.owner = p.owner LEFT JOIN a ON a.replay_id = p.replay_id AND a.owner = p.owner
LEFT JOIN ec ON ec.replay_id = p.replay_id AND ec.owner = p.owner AND ec.rn = 1
LEFT JOIN d d1 ON d1.replay_id = p.replay_id AND d1.owner = p.owner LEFT JOIN d d2 ON d2.replay_id = p.replay_id AND d2.owner = o.opp""",
)
def match_card(t: Tables) -> DataFrame:
    out = cards.match_card(t.corpus, anchors=ANCHORS)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
    fight = F.col("combat_summary")[0]
    return out.select(
        *K, "map", "duration", "opponent_owner",
        F.array_join(F.transform("build_anchors", lambda a: F.concat_ws("@", a["item"], a["time"])), ",").alias("anchors"),
        F.col("economy_benchmarks")[1]["workers"].alias("workers_420"),
        total(fight["lost"]).alias("lost"), total(fight["killed"]).alias("killed"),
    )


# Features.

@query(
    base="m",
    sql="""
WITH m AS (SELECT unnest([3, 5, 8, 12, 14]) AS m),
x AS (SELECT replay_id, owner, unit_type, m, arg_max(count, (time_seconds, frame)) AS v FROM unit_count_samples JOIN m ON time_seconds <= 60 * m WHERE unit_type IN ('LARGE', 'SMALL') GROUP BY ALL)
SELECT replay_id, owner, lower(unit_type) || '_count_at_' || m || 'm' AS feature, CAST(v AS DOUBLE) AS value FROM x""",
)
def feature_matrix_asof(t: Tables) -> DataFrame:
    wanted = [("", u, m) for u in ("large", "small") for m in (3, 5, 8, 12, 14)]
    return features.counts_at_minutes(t.corpus.unit_count_samples, wanted)


@query(
    base="m",
    sql="""
SELECT replay_id, owner, lower(item) || '#' || n AS feature, time_seconds AS value FROM
 (SELECT *, row_number() OVER (PARTITION BY replay_id, owner, item ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item IN ('LARGE', 'PROMO')) WHERE n <= 3""",
)
def feature_matrix_nth(t: Tables) -> DataFrame:
    return features.starts_of(t.corpus.build_order_events, [("", "large", 1), ("", "promo", 3)])


@query(
    base="m",
    sql="""
WITH d AS (SELECT replay_id, count(*) AS n FROM players GROUP BY ALL),
st AS (SELECT replay_id, owner, time_seconds AS t, row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item = 'LARGE'),
uc AS (SELECT replay_id, owner, arg_max(count, (time_seconds, frame)) AS v FROM unit_count_samples WHERE unit_type = 'SMALL' AND time_seconds <= 600 GROUP BY ALL),
ec AS (SELECT replay_id, owner, arg_max(gathered_minerals, (time_seconds, frame)) AS g, arg_max(struct_pack(w := workers), (time_seconds, frame)).w AS w FROM economy_samples WHERE time_seconds <= 600 GROUP BY ALL)
SELECT p.replay_id, p.owner, o.race AS opponent_race, CAST(ec.g AS DOUBLE) AS minerals_10m, CAST(ec.w AS DOUBLE) AS workers_10m, CAST(uc.v AS DOUBLE) AS small_10m, s1.t AS first_large, s2.t AS second_large
FROM players p JOIN d USING (replay_id) LEFT JOIN players o ON o.replay_id = p.replay_id AND o.owner <> p.owner AND d.n = 2
LEFT JOIN st s1 ON s1.replay_id = p.replay_id AND s1.owner = p.owner AND s1.n = 1 LEFT JOIN st s2 ON s2.replay_id = p.replay_id AND s2.owner = p.owner AND s2.n = 2
LEFT JOIN uc ON uc.replay_id = p.replay_id AND uc.owner = p.owner LEFT JOIN ec ON ec.replay_id = p.replay_id AND ec.owner = p.owner WHERE p.race = 'NATION_1'""",
)
def feature_matrix_wide(t: Tables) -> DataFrame:
    c = t.corpus
    zerg = c.players.withColumn("race_lc", F.when(F.col("race") == "NATION_1", "zerg").otherwise("x"))
    from ..schema import Corpus

    view = Corpus(c.replays, zerg, c.build_order_events, c.economy_samples, c.supply_samples, c.unit_count_samples, c.death_events)
    out = features.feature_matrix(
        view, "zerg", extra_counts=[("small_10m", "small", 10)], extra_starts=[("first_large", "large", 1), ("second_large", "large", 2)]
    )
    return out.select(
        *K, "opponent_race", F.col("minerals_gathered_cumulative_at_10m").alias("minerals_10m"),
        F.col("worker_count_at_10m").alias("workers_10m"), "small_10m", "first_large", "second_large",
    )
