"""Queries over events: first, n-th, order, lists, chains, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, padded_clock
from ..operators import combat, events, intervals, scope
from ..operators.asof import asof_rows, interpolate, step_sample
from ..operators.quantiles import summarize
from .adapters import Tables
from .registry import long_summary, query, r6, summary_sql

PLAYER = "Supplier#000000007"
NTH = "row_number() OVER (PARTITION BY {k} ORDER BY time_seconds, {s})"
CLOCK = "(CAST(floor(floor({s} + 0.5) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor({s} + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0'))"


def clock_sql(s: str) -> str:
    return CLOCK.format(s=s)


@query(
    base="e",
    sql=f"""
WITH third AS (SELECT user_id, time_seconds AS t,
       row_number() OVER (PARTITION BY user_id ORDER BY time_seconds, event_id) AS n FROM ev WHERE item = 'purchase'),
s AS (SELECT {summary_sql('t')} FROM third WHERE n = 3)
SELECT *, {clock_sql('min')} AS min_clock, {clock_sql('median')} AS median_clock, {clock_sql('max')} AS max_clock FROM s""",
)
def nth_event_timing(t: Tables) -> DataFrame:
    third = events.nth_per_key(t.events.where(F.col("item") == "purchase"), ["user_id"], 3, order=("time_seconds", "event_id"))
    s = long_summary(summarize(third, "time_seconds"))
    return s.select("*", *[clock(c).alias(f"{c}_clock") for c in ("min", "median", "max")])


@query(
    base="e",
    sql="""
SELECT user_id, item, min(time_seconds) AS first_seconds, arg_min(event_id, (time_seconds, event_id)) AS event_id,
       count(*) AS n FROM ev GROUP BY user_id, item""",
)
def first_event_per_user(t: Tables) -> DataFrame:
    e = t.events
    first = events.first_per_key(e, ["user_id", "item"], ["time_seconds", "event_id"], order=("time_seconds", "event_id"))
    n = e.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"))
    return first.join(n, ["user_id", "item"]).select(
        "user_id", "item", F.col("event.time_seconds").alias("first_seconds"), F.col("event.event_id").alias("event_id"), "n"
    )


PAIR = """
WITH ranked AS (SELECT replay_id, owner, item, time_seconds,
       row_number() OVER (PARTITION BY replay_id, owner, item ORDER BY time_seconds, event_seq) AS n FROM build_order_events),
both_events AS (SELECT p.*, a.time_seconds AS t1, b.time_seconds AS t2 FROM pairs p
  LEFT JOIN ranked a ON a.replay_id = p.replay_id AND a.owner = p.self_owner AND a.item = 'ECONOMY' AND a.n = 1
  LEFT JOIN ranked b ON b.replay_id = p.replay_id AND b.owner = p.self_owner AND b.item = 'PROMO' AND b.n = 1)
"""


@query(
    base="m",
    sql=PAIR
    + """
SELECT count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL) AS sample_size, count(*) FILTER (t1 < t2) AS match_count,
       count(*) FILTER (t1 IS NULL) AS missing_first_count, count(*) FILTER (t2 IS NULL) AS missing_second_count,
       CAST(floor(1000.0 * count(*) FILTER (t1 < t2) / count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL) + 0.5) / 10 AS DOUBLE) AS percentage
FROM both_events""",
)
def event_before_event(t: Tables) -> DataFrame:
    c = t.corpus
    summary, _ = events.event_before_event(c.build_order_events, scope.participants(c.replays, c.players), "Economy", "promo")
    return summary


@query(
    base="m",
    sql=PAIR
    + f"""
SELECT replay_id, self_owner AS owner, opponent_owner, opponent_name, t1 AS first_time, t2 AS second_time, t2 - t1 AS delta,
       {clock_sql('t1')} AS first_clock
FROM both_events WHERE t1 < t2 ORDER BY replay_id, self_owner, opponent_owner NULLS FIRST LIMIT 25""",
)
def event_order_examples(t: Tables) -> DataFrame:
    c = t.corpus
    _, pairs = events.event_before_event(c.build_order_events, scope.participants(c.replays, c.players), "Economy", "promo")
    return events.pair_examples(pairs, c.players, True, 25).select(
        "replay_id", "owner", "opponent_owner", "opponent_name", "first_time", "second_time", "delta", "first_clock"
    )


@query(
    base="m",
    sql=f"""
WITH ranked AS (SELECT replay_id, owner, time_seconds,
       row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item = 'LARGE'),
hits AS (SELECT r.time_seconds FROM pairs p JOIN ranked r ON r.replay_id = p.replay_id AND r.owner = p.self_owner
         WHERE r.n = 1 AND r.time_seconds BETWEEN 200 AND 2000 AND p.matchup = '1-URGENT')
SELECT {summary_sql('time_seconds')} FROM hits""",
)
def event_timing_scope(t: Tables) -> DataFrame:
    c = t.corpus
    parts = scope.participants(c.replays, c.players, matchup="1-URGENT")
    s = events.event_timing_distribution(c.build_order_events, parts, "large", 1, 200, 2000).withColumnRenamed("sample_size", "n")
    return long_summary(s)


@query(
    base="m",
    sql=f"""
WITH ranked AS (SELECT replay_id, owner, time_seconds,
       row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item = 'LARGE')
SELECT p.replay_id, p.self_owner AS owner, p.opponent_owner, r.time_seconds, {clock_sql('r.time_seconds')} AS time
FROM pairs p JOIN ranked r ON r.replay_id = p.replay_id AND r.owner = p.self_owner WHERE r.n = 1
ORDER BY r.time_seconds, p.replay_id, p.self_owner, p.opponent_owner NULLS FIRST LIMIT 25""",
)
def event_timing_examples(t: Tables) -> DataFrame:
    c = t.corpus
    rows = events.event_timings(c.build_order_events, scope.participants(c.replays, c.players), "Large")
    return events.timing_examples(rows, c.players, 25).select("replay_id", "owner", "opponent_owner", "time_seconds", "time")


@query(
    base="m",
    sql=f"""
SELECT b.replay_id, p.owner AS self_owner, b.owner, p.name AS player_name, r.matchup, b.time_seconds, b.supply_used, b.item, b.raw_line
FROM players p JOIN replays r USING (replay_id) JOIN build_order_events b ON b.replay_id = p.replay_id AND b.owner = p.owner
WHERE p.name = '{PLAYER}' AND b.time_seconds BETWEEN 300 AND 1500""",
)
def event_list_window(t: Tables) -> DataFrame:
    c = t.corpus
    who = scope.targets(c.players, c.replays, player=PLAYER.upper())
    return events.event_list(c.build_order_events, who, lo=300, hi=1500).select(
        "replay_id", "self_owner", "owner", "player_name", "matchup", "time_seconds", "supply_used", "item", "raw_line"
    )


@query(
    base="m",
    sql=f"""
WITH hit AS (SELECT replay_id, owner, time_seconds, supply_used,
       row_number() OVER (PARTITION BY replay_id, owner ORDER BY time_seconds, event_seq) AS n FROM build_order_events WHERE item = 'SMALL')
SELECT p.replay_id, p.owner, h.time_seconds, h.supply_used FROM players p JOIN replays r USING (replay_id)
LEFT JOIN hit h ON h.replay_id = p.replay_id AND h.owner = p.owner AND h.n = 2 WHERE p.name = '{PLAYER}'""",
)
def nth_event_targets(t: Tables) -> DataFrame:
    c = t.corpus
    who = scope.targets(c.players, c.replays, player=PLAYER)
    return events.nth_event(c.build_order_events, who, "small", 2).select(
        "replay_id", "owner", F.col("event.time_seconds").alias("time_seconds"), F.col("event.supply_used").alias("supply_used")
    )


@query(
    base="m",
    sql=f"""
WITH hit AS (SELECT replay_id, owner, min(time_seconds) AS time_seconds FROM build_order_events WHERE item = 'MEDIUM' GROUP BY ALL)
SELECT p.replay_id, p.owner AS self_owner, e.owner, e.name AS target_name, h.time_seconds
FROM players p JOIN replays r USING (replay_id) JOIN players e ON e.replay_id = p.replay_id AND e.owner <> p.owner
LEFT JOIN hit h ON h.replay_id = e.replay_id AND h.owner = e.owner WHERE p.name = '{PLAYER}'""",
)
def perspective_enemy_first_event(t: Tables) -> DataFrame:
    c = t.corpus
    who = scope.targets(c.players, c.replays, player=PLAYER, side="enemy")
    return events.first_event(c.build_order_events, who, "Medium").select(
        "replay_id", "self_owner", "owner", "target_name", F.col("event.time_seconds").alias("time_seconds")
    )


def _purchases_and_clicks(t: Tables) -> tuple[DataFrame, DataFrame]:
    samples = t.events.where(F.col("item") == "purchase").select("user_id", "time_seconds", "value", "event_id")
    probes = t.events.where(F.col("item") == "click").select("user_id", "time_seconds", F.col("event_id").alias("probe_id"))
    return samples, probes


ASOF = """
WITH s AS (SELECT user_id, time_seconds, value FROM ev WHERE item = 'purchase'),
p AS (SELECT user_id, time_seconds, event_id AS probe_id FROM ev WHERE item = 'click')
"""


@query(
    base="e",
    sql=ASOF + "SELECT p.user_id, p.probe_id, s.value, s.time_seconds AS sample_seconds FROM p ASOF LEFT JOIN s ON s.user_id = p.user_id AND p.time_seconds >= s.time_seconds",
)
def asof_per_row(t: Tables) -> DataFrame:
    samples, probes = _purchases_and_clicks(t)
    return asof_rows(samples, probes, ["user_id"], ["value"], tie=["event_id"]).select(
        "user_id", "probe_id", F.col("sample.value").alias("value"), F.col("sample.time_seconds").alias("sample_seconds")
    )


@query(
    base="e",
    sql=ASOF
    + """, f AS (SELECT user_id, arg_min(value, time_seconds) AS v0 FROM s GROUP BY user_id)
SELECT p.user_id, p.probe_id, coalesce(s.value, f.v0) AS value FROM p
ASOF LEFT JOIN s ON s.user_id = p.user_id AND p.time_seconds >= s.time_seconds LEFT JOIN f ON f.user_id = p.user_id""",
)
def asof_clamped_step(t: Tables) -> DataFrame:
    samples, probes = _purchases_and_clicks(t)
    return step_sample(samples, probes, ["user_id"], ["value"], tie=["event_id"]).select(
        "user_id", "probe_id", F.col("sample.value").alias("value")
    )


@query(
    base="e",
    sql=ASOF
    + """, n AS (SELECT p.user_id, p.probe_id, p.time_seconds AS t, a.time_seconds AS t0, a.value AS v0 FROM p
      ASOF LEFT JOIN s a ON a.user_id = p.user_id AND p.time_seconds >= a.time_seconds),
m AS (SELECT n.*, b.time_seconds AS t1, b.value AS v1 FROM n ASOF LEFT JOIN s b ON b.user_id = n.user_id AND n.t <= b.time_seconds)
SELECT user_id, probe_id, round(CASE WHEN t0 IS NULL OR t1 = t THEN v1 WHEN t1 IS NULL THEN v0
       ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS value FROM m""",
)
def asof_interpolated(t: Tables) -> DataFrame:
    samples, probes = _purchases_and_clicks(t)
    out = interpolate(samples, probes, ["user_id"], ["value"], tie=["event_id"])
    return out.select("user_id", "probe_id", r6("value").alias("value"))


@query(
    base="m",
    sql=f"""
WITH first_sample AS (SELECT replay_id, owner, arg_min(current || '/' || max, (time_seconds, frame)) AS s0 FROM supply_samples GROUP BY ALL),
one AS (SELECT replay_id, owner, time_seconds, arg_max(current || '/' || max, frame) AS s FROM supply_samples GROUP BY ALL)
SELECT b.replay_id, b.owner, b.event_seq, b.item, {clock_sql('b.time_seconds')} AS clock, coalesce(one.s, s0) AS supply
FROM build_order_events b ASOF LEFT JOIN one ON one.replay_id = b.replay_id AND one.owner = b.owner AND b.time_seconds >= one.time_seconds
JOIN first_sample f ON f.replay_id = b.replay_id AND f.owner = b.owner WHERE b.item <> 'PROMO'""",
)
def build_order_with_supply(t: Tables) -> DataFrame:
    c = t.corpus
    return events.build_order_with_supply(c.build_order_events, c.supply_samples, skip=("PROMO",)).select(
        "replay_id", "owner", "event_seq", "item", "clock", "supply"
    )


CHAIN = """
WITH cat AS (SELECT name, build_time, minerals FROM catalog),
raw AS (SELECT l_orderkey AS replay_id, (l_partkey * 100 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS line, l_suppkey AS owner, CAST(l_quantity AS INT) AS q, p_type
        FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


@query(
    base="m",
    sql=CHAIN
    + """, links AS (
 SELECT replay_id, owner, line, 0 AS link, q * 60 AS t0, p_type AS name FROM raw
 UNION ALL SELECT replay_id, owner, line, 1, q * 60, 'PROMO' FROM raw
 UNION ALL SELECT replay_id, owner, line, 2, q * 60, 'LARGE' FROM raw)
SELECT l.replay_id, l.owner, l.line, l.link, l.name AS item,
  t0 + coalesce(sum(build_time) OVER (PARTITION BY l.replay_id, l.owner, l.line ORDER BY l.link ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS time_seconds
FROM links l JOIN cat ON cat.name = l.name""",
)
def chained_starts(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    text = F.concat(q, F.lit(":00 "), F.lower("p_type"), F.lit(" -> promo ->  Large"))
    line = F.col("seq") * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lines = t.typed_lines.select("replay_id", "owner", line.alias("line"), text.alias("text"))
    return events.chained_starts(lines, t.catalog, ["replay_id", "owner"]).select(
        "replay_id", "owner", "line", "link", "item", "time_seconds"
    )


@query(
    base="m",
    sql="""
WITH items AS (SELECT owner AS k, l_linenumber % 2 AS side, time_seconds AS s, time_seconds + l_quantity AS e FROM lines),
edges AS (SELECT k, side, s AS tt, 1 AS step FROM items UNION ALL SELECT k, side, e, -1 FROM items),
running AS (SELECT k, side, sum(step) OVER (PARTITION BY k, side ORDER BY tt, step ROWS UNBOUNDED PRECEDING) AS busy FROM edges)
SELECT k, side, CAST(max(busy) AS BIGINT) AS lanes FROM running GROUP BY k, side""",
)
def lane_packing(t: Tables) -> DataFrame:
    """First-fit needs as many lanes as items ever run at once, which SQL can count."""
    items = t.lines.select(
        F.col("owner").alias("k"), (F.col("l_linenumber") % 2).alias("side"), "time_seconds",
        F.col("l_quantity").alias("build_time"), F.lit(0).alias("is_unit"),
        (F.col("replay_id") * 100_000_000 + F.col("seq")).alias("event_seq"),
    )
    packed = intervals.lanes(items, ["k", "side"])
    return packed.groupBy("k", "side").agg((F.max("lane") + 1).cast("bigint").alias("lanes"))


@query(
    sql="""SELECT l_orderkey AS replay_id, l_partkey AS id, l_linenumber AS n, l_quantity AS s,
 CASE WHEN l_quantity IS NULL THEN 'unknown' ELSE CAST(CAST(floor(floor(l_extendedprice / 60 + 0.5) / 60) AS BIGINT) AS VARCHAR) || ':' ||
   lpad(CAST(CAST(floor(l_extendedprice / 60 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock,
 lpad(CAST(CAST(floor(floor(l_extendedprice / 60) / 60) AS BIGINT) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(floor(floor(l_extendedprice / 60) / 60) AS BIGINT) AS VARCHAR))) AS INT), '0') || ':' ||
   lpad(CAST(CAST(floor(l_extendedprice / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS padded FROM lineitem"""
)
def clock_format(t: Tables) -> DataFrame:
    s = F.col("l_extendedprice") / 60
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("replay_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("n"),
        F.col("l_quantity").alias("s"), clock(s).alias("clock"), padded_clock(s).alias("padded"),
    )


def _starts_points(t: Tables) -> tuple[DataFrame, DataFrame]:
    ident = F.col("replay_id") * 10000000 + F.col("seq")
    side = lambda n, name: t.lines.where(F.col("l_linenumber") == n).select(F.col("owner").alias("k"), ident.alias(name), "time_seconds")
    return side(1, "start_id"), side(2, "point_id")


@query(
    base="m",
    sql="""
WITH a AS (SELECT owner AS k, time_seconds AS ts, count(*) AS n FROM lines WHERE l_linenumber = 1 GROUP BY ALL),
b AS (SELECT owner AS k, time_seconds AS ts, count(*) AS n FROM lines WHERE l_linenumber = 2 GROUP BY ALL)
SELECT a.k, a.ts AS time_seconds, least(a.n, b.n) AS matched FROM a JOIN b ON a.k = b.k AND a.ts = b.ts""",
)
def greedy_interval_match(t: Tables) -> DataFrame:
    starts, points = _starts_points(t)
    found = combat.match_intervals(starts, points, ["k"], 0.5)
    return found.join(starts, ["k", "start_id"]).groupBy("k", "time_seconds").agg(F.count(F.lit(1)).alias("matched"))
