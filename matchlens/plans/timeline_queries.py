"""Queries over snapshot timelines: scans and the reduction to series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import TECH_NAMES, UPGRADE_NAMES
from ..operators import reduction
from ..operators.changes import frame_gaps
from ..sources.timelines import parse_jsonl
from .adapters import Tables
from .registry import query

K = ["replay_id", "owner"]


def _flat(t: Tables) -> reduction.Timeline:
    return reduction.explode_timeline(t.snapshots)


@query(
    base="t",
    sql="""SELECT replay_id, owner, frame, frame * 42 / 1000.0 AS time_seconds, mq AS minerals, mp AS gas, c AS workers FROM owners WHERE mq < 49""",
)
def timeline_jsonl_economy(t: Tables) -> DataFrame:
    """Snapshots written as JSON lines, read back through the JSON-line source."""
    lines = t.snapshots.select(
        F.col("replay_id").cast("string").alias("path"), F.to_json(F.struct("frame", "owners", "deaths")).alias("text")
    )
    noise = t.read("supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.lit("  ").alias("text"))
    good, _ = parse_jsonl(lines.unionByName(noise))
    raw = good.withColumn("replay_id", F.col("path").cast("bigint")).drop("path")
    out = reduction.economy_series(reduction.explode_timeline(raw).owners)
    return out.select(*K, "frame", "time_seconds", "minerals", "gas", "workers")


@query(
    base="t",
    sql="""SELECT replay_id, owner, frame, mq % 3 AS current FROM
 (SELECT *, lag(mq % 3) OVER (PARTITION BY replay_id, owner ORDER BY frame) AS p FROM owners) WHERE p IS NULL OR p <> mq % 3""",
)
def supply_compaction(t: Tables) -> DataFrame:
    return reduction.supply_series(_flat(t).owners).select(*K, "frame", "current")


@query(
    base="t",
    sql="""SELECT replay_id, owner, frame, c AS drones FROM
 (SELECT *, lag(c) OVER (PARTITION BY replay_id, owner ORDER BY frame) AS p FROM owners) WHERE p IS NULL OR p <> c""",
)
def unit_count_compaction(t: Tables) -> DataFrame:
    out = reduction.count_series(_flat(t).owners).where(F.size("counts") == 1)
    return out.select(*K, "frame", F.col("counts")["drone"].alias("drones"))


@query(
    base="t",
    sql="""
WITH q AS (SELECT *, lag(queue) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS prev FROM units WHERE ordinal > 1),
x AS (SELECT replay_id, owner, unit_id, frame, queue, coalesce(prev, []) AS prev, unnest(list_distinct(queue)) AS target FROM q)
SELECT * FROM (SELECT replay_id, owner, unit_id, frame, CAST(target AS INT) AS target,
 CAST(len(list_filter(queue, lambda y: y = target)) - len(list_filter(prev, lambda y: y = target)) AS INT) AS copies FROM x) WHERE copies > 0""",
)
def queue_increments(t: Tables) -> DataFrame:
    return reduction.queue_increments(_flat(t).units).select("replay_id", "owner", "unit_id", "frame", "target", "copies")


@query(
    base="t",
    sql="""
WITH st AS (SELECT *, lag(unit_type_id) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS ptype FROM units),
a AS (SELECT replay_id, owner, unit_id, frame, -1 AS pos, coalesce(morph, unit_type_id) AS target, build_time, remaining FROM st
 WHERE ordinal > 1 AND (morph IS NOT NULL OR (category = 'building' AND (ptype IS NULL OR ptype <> unit_type_id)))),
q AS (SELECT *, lag(queue) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS prev FROM units WHERE ordinal > 1),
x AS (SELECT replay_id, owner, unit_id, frame, queue, coalesce(prev, []) AS prev, morphing, build_time, remaining, unnest(list_distinct(queue)) AS target FROM q),
b AS (SELECT replay_id, owner, unit_id, frame, 0 AS pos, target, build_time, remaining FROM x WHERE morphing AND target BETWEEN 106 AND 172
  AND len(list_filter(queue, lambda y: y = target)) > len(list_filter(prev, lambda y: y = target))),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b),
d AS (SELECT *, lag(target) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame, pos) AS last_t FROM c)
SELECT replay_id, owner, unit_id, CAST(target AS INT) AS target, frame AS seen_frame,
 CAST(CASE WHEN build_time > 0 AND remaining >= 0 THEN greatest(0, frame - greatest(0, least(build_time, build_time - remaining))) ELSE frame END AS INT) AS frame
FROM d WHERE last_t IS NULL OR last_t <> target""",
)
def build_start_dedupe(t: Tables) -> DataFrame:
    units, known = reduction._named_units(_flat(t).units, None)
    cand = reduction.start_candidates(units, known, structure=lambda target: target.between(106, 172))
    return reduction.building_starts(cand).select("replay_id", "owner", "unit_id", "target", "seen_frame", "frame")


UP = ", ".join(f"'{n}'" for n in UPGRADE_NAMES[:4])
TE = ", ".join(f"'{n}'" for n in TECH_NAMES[:3])


@query(
    base="t",
    sql=f"""
WITH r AS (SELECT DISTINCT replay_id, owner, frame, ordinal, 'upgrade' AS kind, upgrade AS ident FROM units WHERE upgrade IS NOT NULL
 UNION SELECT DISTINCT replay_id, owner, frame, ordinal, 'tech', tech FROM units WHERE tech IS NOT NULL),
l AS (SELECT *, lag(ordinal) OVER (PARTITION BY replay_id, owner, kind, ident ORDER BY ordinal) AS p FROM r)
SELECT replay_id, owner, frame, kind, CAST(ident AS INT) AS ident, CASE kind WHEN 'upgrade' THEN [{UP}][ident + 1] ELSE [{TE}][ident + 1] END AS name
FROM l WHERE ordinal > 1 AND (p IS NULL OR p < ordinal - 1)""",
)
def research_starts(t: Tables) -> DataFrame:
    return reduction.research_starts(_flat(t).researching, include_tech=True).select(*K, "frame", "kind", "ident", "name")


@query(
    base="t",
    sql="""
WITH r AS (SELECT replay_id, owner, CASE WHEN unit_type_id BETWEEN 0 AND 34 OR unit_type_id BETWEEN 106 AND 130 THEN 'terran' ELSE 'zerg' END AS race, count(*) AS n FROM units GROUP BY ALL)
SELECT replay_id, owner, arg_min(race, (-n, race)) AS race FROM r GROUP BY ALL""",
)
def race_mode(t: Tables) -> DataFrame:
    return reduction.infer_race(_flat(t).unit_rows)


@query(
    base="t",
    sql="""
WITH f AS (SELECT DISTINCT replay_id, frame FROM lines), d AS (SELECT replay_id, frame - lag(frame) OVER (PARTITION BY replay_id ORDER BY frame) AS d FROM f)
SELECT replay_id, coalesce(max(d), 0) AS max_frame_delta, coalesce(max(d), 0) > 1 AS frames_skipped FROM d GROUP BY replay_id""",
)
def frame_gap_check(t: Tables) -> DataFrame:
    return frame_gaps(t.snapshots.select("replay_id", "frame"))


@query(
    base="t",
    sql="""
WITH n AS (SELECT replay_id, owner, arg_min('name' || owner, frame) FILTER (mq % 3 = 0) AS name FROM owners GROUP BY ALL),
r AS (SELECT replay_id, owner, CASE WHEN unit_type_id BETWEEN 106 AND 130 THEN 'terran' ELSE 'zerg' END AS race, count(*) AS n FROM units GROUP BY ALL),
m AS (SELECT replay_id, owner, arg_min(race, (-n, race)) AS race FROM r GROUP BY ALL),
w AS (SELECT replay_id, string_agg(upper(substr(race, 1, 1)), 'v' ORDER BY owner) AS matchup FROM m GROUP BY ALL),
l AS (SELECT replay_id, max(frame) * 42 / 1000.0 AS duration_seconds FROM lines GROUP BY ALL)
SELECT n.replay_id, n.owner, coalesce(name, 'Player ' || (n.owner + 1)) AS name, race, matchup, CAST(duration_seconds AS DOUBLE) AS duration_seconds
FROM n JOIN m USING (replay_id, owner) JOIN w USING (replay_id) JOIN l USING (replay_id)""",
)
def timeline_participants(t: Tables) -> DataFrame:
    out = reduction.reduce_timeline(t.snapshots)
    return out["participants"].join(out["matches"], "replay_id").select(*K, "name", "race", "matchup", "duration_seconds")


@query(
    base="t",
    sql="""
WITH q AS (SELECT *, lag(queue) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS prev FROM units WHERE ordinal > 1),
x AS (SELECT replay_id, owner, frame, queue, coalesce(prev, []) AS prev, unnest(list_distinct(queue)) AS target FROM q)
SELECT DISTINCT replay_id, owner, frame, CASE target WHEN 37 THEN 'Type 37' WHEN 38 THEN 'Type 38' ELSE 'Unit 39' END AS item, floor(frame * 42 / 1000.0) AS time_seconds
FROM x WHERE target < 100 AND len(list_filter(queue, lambda y: y = target)) > len(list_filter(prev, lambda y: y = target))""",
)
def trained_events(t: Tables) -> DataFrame:
    """Queue part of the build events: names from observed units, `unit_N` otherwise."""
    names = t.spark.range(36, 39).select(F.col("id").alias("type_id"), F.concat(F.lit("type_"), F.col("id").cast("string")).alias("type_name"))
    events = reduction.build_events(_flat(t).units, names)
    return events.where(F.col("item").isin("Type 37", "Type 38", "Unit 39"))
