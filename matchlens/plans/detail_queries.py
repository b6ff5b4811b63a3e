"""Queries of single steps: deaths and appearances of timelines, unit starts as a stream, n-th starters, folded names, the corpus index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combat, losses, reduction, scope
from ..operators.ordered import row_place
from ..operators.starters import STARTERS
from ..schema import Corpus, with_folded
from ..sources import bundles, sinks, staging
from ..streaming import starts
from .adapters import Tables
from .event_queries import PLAYER
from .registry import query

K = ["replay_id", "owner"]


def _with_deaths(t: Tables) -> DataFrame:
    """The snapshots, with a death for every line that was returned."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(p % 9 == 0, "siege_tank_tank").when(p % 4 == 0, "goliath_turret").otherwise(F.concat(F.lit("type_"), (p % 3).cast("string")))
    death = F.struct(
        p.cast("int").alias("id"), (n % 2).cast("int").alias("owner"), kind.alias("unit_type"), (p % 3).cast("int").alias("unit_type_id"),
        F.when(n == 1, "worker").when(n == 2, "resource").otherwise("unit").alias("category"), n.cast("int").alias("pos_x"), F.lit(7).alias("pos_y"))
    lost = t.lines.where(F.col("l_returnflag") == "R").groupBy(
        F.col("owner").alias("replay_id"), F.col("time_seconds").cast("int").alias("frame")).agg(F.array_sort(F.collect_list(death)).alias("deaths"))
    none = F.array().cast(lost.schema["deaths"].dataType)
    return t.snapshots.drop("deaths").join(lost, ["replay_id", "frame"], "left").withColumn("deaths", F.coalesce("deaths", none))


@query(
    base="m",
    sql="""
SELECT owner AS replay_id, l_linenumber % 2 AS owner, CAST(time_seconds AS INT) AS frame, l_linenumber % 2 AS dead_owner,
 CASE WHEN l_partkey % 9 = 0 THEN 'siege_tank' ELSE 'type_' || (l_partkey % 3) END AS unit_type,
 CASE l_linenumber WHEN 1 THEN 'worker' WHEN 2 THEN 'resource' ELSE 'unit' END AS category, l_partkey AS unit_id, l_linenumber AS pos_x,
 count(*) AS copies
FROM lines WHERE l_returnflag = 'R' AND (l_partkey % 9 = 0 OR l_partkey % 4 <> 0) GROUP BY ALL""",
)
def timeline_deaths(t: Tables) -> DataFrame:
    """Deaths from snapshots, as the reduction has them; turrets are omitted and the tank has one name."""
    out = reduction.reduce_timeline(_with_deaths(t))["deaths"]
    cells = [*K, "frame", "dead_owner", "unit_type", "category", "unit_id", "pos_x"]
    return out.groupBy(*cells).agg(F.count(F.lit(1)).alias("copies"))


_STARTS = """
st AS (SELECT *, lag(unit_type_id) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS ptype FROM units),
a AS (SELECT replay_id, owner, unit_id, frame, -1 AS pos, coalesce(morph, unit_type_id) AS target FROM st
 WHERE {later} AND (morph IS NOT NULL OR (category = 'building' AND (ptype IS NULL OR ptype <> unit_type_id)))),
q AS (SELECT *, lag(queue) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame) AS prev FROM units WHERE {later}),
x AS (SELECT replay_id, owner, unit_id, frame, queue, coalesce(prev, []) AS prev, morphing, unnest(list_distinct(queue)) AS target FROM q),
grown AS (SELECT *, len(list_filter(queue, lambda y: y = target)) - len(list_filter(prev, lambda y: y = target)) AS copies FROM x),
c AS (SELECT * FROM a UNION ALL SELECT replay_id, owner, unit_id, frame, 0, target FROM grown WHERE copies > 0 AND morphing AND target BETWEEN 106 AND 172),
d AS (SELECT *, lag(target) OVER (PARTITION BY replay_id, owner, unit_id ORDER BY frame, pos) AS last_t FROM c)"""


@query(
    base="t",
    sql="WITH " + _STARTS.format(later="ordinal > 1").strip() + """
SELECT replay_id, owner, frame, 'type_' || unit_type_id AS unit_type, count(*) AS units FROM st
WHERE ordinal > 1 AND category <> 'building' AND (ptype IS NULL OR ptype <> unit_type_id)
 AND NOT EXISTS (SELECT 1 FROM d WHERE d.replay_id = st.replay_id AND d.owner = st.owner AND d.unit_id = st.unit_id AND d.frame = st.frame AND pos = -1 AND (last_t IS NULL OR last_t <> target))
GROUP BY ALL""",
)
def unit_appearances(t: Tables) -> DataFrame:
    """New or changed units, but those that started a building in the same frame."""
    flat = reduction.explode_timeline(t.snapshots)
    units, known = reduction._named_units(flat.units, None)
    units = reduction.unit_steps(units)
    out = reduction.appearances(units, known, structure=lambda target: target.between(106, 172))
    return out.groupBy(*K, "frame", "unit_type").agg(F.count(F.lit(1)).alias("units"))


@query(
    base="t",
    sql="WITH " + _STARTS.format(later="frame > 100").strip() + """
SELECT replay_id, owner, unit_id, frame, CAST(target AS INT) AS target, 'building' AS kind, CAST(1 AS BIGINT) AS copies FROM d WHERE last_t IS NULL OR last_t <> target
UNION ALL SELECT replay_id, owner, unit_id, frame, CAST(target AS INT), 'unit', CAST(copies AS BIGINT) FROM grown WHERE copies > 0 AND target NOT BETWEEN 106 AND 172""",
)
def stream_unit_starts(t: Tables) -> DataFrame:
    """Starts of buildings and units as snapshots arrive in four parts, each found by a later run of the stream."""
    folder, root, checkpoint = (staging.new_path(t.spark, x) for x in ("snapshots", "starts", "checkpoint"))
    units = reduction.explode_timeline(t.snapshots).unit_rows.select(
        *K, "unit_id", "frame", "unit_type_id", "category", "build_queue_unit_ids", "morph_target_unit_type_id", "morphing_building",
        F.timestamp_micros((F.col("frame") * 42_000).cast("long")).alias("ts"))
    units = staging.stage(units, "units")
    for part, (lo, hi) in enumerate(((-1, 500), (500, 1200), (1200, 1800), (1800, 1 << 30))):
        units.where((F.col("frame") > lo) & (F.col("frame") <= hi)).write.parquet(f"{folder}/{part}")
        stream = t.spark.readStream.schema(units.schema).option("recursiveFileLookup", True).parquet(folder)
        starts.start(stream, root, checkpoint, first_frame=100).awaitTermination()
    found = starts.starts(t.spark, root).where(~F.col("late"))
    return found.groupBy(*K, "unit_id", F.col("frame").cast("bigint").alias("frame"), "target", "kind").agg(F.sum("copies").alias("copies"))


def _wide(t: Tables) -> Corpus:
    """The corpus under fewer keys, so that a participant has many events of an item."""
    c = t.corpus
    match, owner = (F.col("replay_id") % 50).alias("replay_id"), (F.col("owner") % 7).alias("owner")
    events = c.build_order_events.select(match, owner, *[x for x in c.build_order_events.columns if x not in K])
    people = c.players.select(match, owner).distinct().select(
        *K, F.concat(F.lit("p"), F.col("owner").cast("string")).alias("name"), F.when(F.col("owner") % 2 == 0, "Zerg").otherwise("TERRAN").alias("race"),
        F.lit(None).cast("string").alias("zip_path"))
    matches = c.replays.groupBy(match).agg(F.min("source_replay_filename").alias("source_replay_filename")).select(
        "replay_id", "source_replay_filename", F.lit(None).cast("string").alias("source_replay_path"), F.lit("ZvT").alias("matchup"),
        F.lit(None).cast("string").alias("map"), F.lit(0.0).alias("duration_seconds"), F.lit("m").alias("manifest_path"))
    return Corpus(matches, with_folded(people, "players"), events, c.economy_samples, c.supply_samples, c.unit_count_samples, c.death_events)


_WIDE = """
e AS (SELECT replay_id % 50 AS replay_id, owner % 7 AS owner, lower(item) AS item, time_seconds, event_seq FROM build_order_events),
n AS (SELECT *, row_number() OVER (PARTITION BY replay_id, owner, item ORDER BY time_seconds, event_seq) AS place FROM e),
w AS (SELECT replay_id % 50 AS replay_id, min(source_replay_filename) AS source_replay_filename FROM replays GROUP BY 1),
p AS (SELECT DISTINCT replay_id % 50 AS replay_id, owner % 7 AS owner, 'p' || (owner % 7) AS name FROM players)"""


@query(
    base="m",
    sql="WITH " + _WIDE.strip() + """
SELECT source_replay_filename, name, replay_id, owner, time_seconds FROM n JOIN w USING (replay_id) JOIN p USING (replay_id, owner) WHERE item = 'large' AND place = 3""",
)
def curated_third_occurrence(t: Tables) -> DataFrame:
    return STARTERS["nth_occurrence"](_wide(t), item="LARGE", n=3)


@query(
    base="m",
    sql="WITH " + _WIDE.strip() + """
SELECT name, source_replay_filename, a.time_seconds AS nth_seconds, b.time_seconds AS first_seconds, b.time_seconds - a.time_seconds AS delta_seconds
FROM n a JOIN n b ON b.replay_id = a.replay_id AND b.owner = a.owner AND b.item = 'promo' AND b.place = 1 JOIN w ON w.replay_id = a.replay_id
JOIN p ON p.replay_id = a.replay_id AND p.owner = a.owner WHERE a.item = 'large' AND a.place = 2 AND a.time_seconds < b.time_seconds""",
)
def curated_sequence_after_second(t: Tables) -> DataFrame:
    return STARTERS["event_sequence"](_wide(t), item="large", n=2, then="Promo")


@query(
    base="m",
    sql="""
WITH x AS (SELECT * FROM players WHERE upper(race) IN ('NATION_1', 'NATION_2', 'NATION_3')),
q AS (SELECT name, race FROM x ORDER BY name LIMIT 1)
SELECT DISTINCT r.replay_id, matchup FROM replays r JOIN players p USING (replay_id) JOIN q ON lower(q.name) = lower(p.name) AND lower(q.race) = lower(p.race)""",
)
def find_by_name_and_race(t: Tables) -> DataFrame:
    """Matches with a participant of a name and a race, both in another case; they must hold on one row."""
    c = t.corpus
    who = c.players.where(F.upper("race").isin("NATION_1", "NATION_2", "NATION_3")).orderBy("name").select("name", "race").first()
    if who is None:
        return c.replays.limit(0).select("replay_id", "matchup")
    return scope.find_matches(c.replays, c.players, player=who.name.swapcase(), race=who.race.swapcase()).select("replay_id", "matchup")


@query(
    base="m",
    sql="""SELECT CAST(replay_id AS VARCHAR) AS replay_id, source_replay_filename, matchup, duration_seconds, manifest_path,
 row_number() OVER (ORDER BY CAST(replay_id AS VARCHAR)) AS place FROM replays""",
)
def corpus_index(t: Tables) -> DataFrame:
    """The index as JSON lines, read back in the order of its files."""
    path = staging.new_path(t.spark, "index")
    rows = t.corpus.replays.withColumn("replay_id", F.col("replay_id").cast("string"))
    sinks.corpus_index(rows).write.json(path)
    back = t.spark.read.schema("replay_id string, source_replay_filename string, matchup string, duration_seconds double, manifest_path string").json(path)
    files = back.select("*", F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    return row_place(files.withColumn("_all", F.lit(0)), ["_all"], ["_f", "_i"], "place").drop("_all", "_f", "_i")


def _member_archives(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Unit counts and deaths of every supplier's days as archive members, and the archives' manifests' wishes."""
    lines = t.lines.withColumnRenamed("owner", "supplier").select(
        F.col("supplier").alias("replay_id"), (F.col("l_linenumber") % 2).cast("int").alias("owner"), "time_seconds", "l_partkey", "l_linenumber", "l_returnflag")
    day = lines.groupBy(*K, "time_seconds").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("l_partkey").cast("int").alias("id"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("int").alias("r"))
    stamp = [F.col("time_seconds").cast("int").alias("frame"), F.col("time_seconds")]
    counts = F.struct(*stamp, F.create_map(F.lit("Drone"), F.col("n"), F.lit("zergling"), F.col("r")).alias("counts"))
    death = F.struct(*stamp, F.struct(F.col("id"), F.col("owner"), F.lit("Drone").alias("unit_type"), F.lit(41).alias("unit_type_id"), F.lit("worker").alias("category")).alias("death"))

    def document(samples):
        return F.to_json(F.struct(samples.alias("samples")))

    sides = day.groupBy(*K).agg(
        document(F.collect_list(counts)).alias("unit_counts.json"), document(F.collect_list(F.when(F.col("r") > 0, death))).alias("deaths.json"))
    zip_path = F.concat_ws("/", F.lit("z"), F.col("replay_id").cast("string"), F.col("owner").cast("string")).alias("zip_path")
    fixed = {
        "player.json": F.to_json(F.struct("owner")), "build_order.txt": F.lit("00:01 Drone"), "economy.json": F.lit('{"samples":[]}'), "supply.json": F.lit('{"samples":[]}')}
    parts = F.array(*[F.struct(F.lit(m).alias("member"), v.alias("text")) for m, v in {**fixed, "unit_counts.json": F.col("`unit_counts.json`"), "deaths.json": F.col("`deaths.json`")}.items()])
    members = staging.stage(sides.select(*K, zip_path, F.inline(parts), F.lit(None).cast("string").alias("problem")), "members", ["member"])
    # Every archive has one such member.
    wanted = members.where(F.col("member") == "player.json").select(*K, F.lit("n").alias("name"), F.lit("zerg").alias("race"), "zip_path")
    return members, wanted


@query(
    base="m",
    sql="""
WITH d AS (SELECT owner AS replay_id, CAST(l_linenumber % 2 AS INT) AS owner, CAST(time_seconds AS BIGINT) AS frame, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, min(l_partkey) AS id FROM lines GROUP BY ALL)
SELECT replay_id, owner, frame, 'count' AS kind, 'Drone' AS unit_type, 'drone' AS folded, CAST(n AS INT) AS value FROM d
UNION ALL SELECT replay_id, owner, frame, 'count', 'zergling', 'zergling', CAST(r AS INT) FROM d
UNION ALL SELECT replay_id, owner, frame, 'death', 'Drone', 'worker', owner FROM d WHERE r > 0""",
)
def archive_counts_and_deaths(t: Tables) -> DataFrame:
    """The optional members of archives, flattened: unit counts and deaths."""
    members, wanted = _member_archives(t)
    manifests = t.read("supplier").select(F.col("s_suppkey").alias("replay_id"))
    tables, errors = bundles.parse_series(bundles.judge_bundles(members, wanted), manifests)
    tables = bundles.faultless(tables, staging.stage(errors, "errors"))
    counts = tables["unit_count_samples"].select(*K, "frame", F.lit("count").alias("kind"), "unit_type", F.col("unit_type_lc").alias("folded"), F.col("count").alias("value"))
    deaths = tables["death_events"].select(*K, "frame", F.lit("death").alias("kind"), "unit_type", F.col("category").alias("folded"), F.col("dead_owner").alias("value"))
    return counts.unionByName(deaths)


# The order of losses.

_SEEN = """v AS (SELECT c.*, p.owner AS self_owner, CASE WHEN c.owner = p.owner THEN 'own' ELSE 'enemy' END AS side
 FROM combat c JOIN players p USING (replay_id))"""


@query(
    base="m",
    sql=f"""
WITH {_SEEN}
SELECT replay_id, self_owner, death_id, side, unit_key, row_number() OVER (PARTITION BY replay_id, self_owner ORDER BY time_seconds,
 side = 'own', CASE category WHEN 'worker' THEN 0 WHEN 'unit' THEN 1 WHEN 'building' THEN 2 ELSE 3 END, display_name, death_id) AS place FROM v""",
)
def combat_places(t: Tables) -> DataFrame:
    """Every loss's place in its match's report, as each participant sees it."""
    events = combat.combat_events(t.corpus.death_events, t.catalog)
    return combat.combat_places(combat.seen_from(events, t.corpus.players), original=("death_id",)).select("replay_id", "self_owner", "death_id", "side", "unit_key", "place")


@query(
    base="m",
    sql=f"""
SELECT p.replay_id, p.owner, count(d.death_id) AS n,
 coalesce(string_agg(d.unit_type || '@' || d.frame, ',' ORDER BY d.time_seconds, d.frame), '') AS listed FROM players p
LEFT JOIN death_events d ON d.replay_id = p.replay_id AND d.owner = p.owner AND d.time_seconds BETWEEN 600 AND 1200
WHERE p.name = '{PLAYER}' GROUP BY ALL""",
)
def deaths_between_nested(t: Tables) -> DataFrame:
    """Deaths of a window gathered per target by (time, frame); a target without any has an empty list."""
    c = t.corpus
    found = losses.losses_between(c.death_events, scope.targets(c.players, c.replays, player=PLAYER), 600, 1200, nested=True)
    shown = F.transform("deaths", lambda d: F.concat(d["unit_type"], F.lit("@"), d["frame"].cast("string")))
    return found.select(*K, F.size("deaths").cast("bigint").alias("n"), F.concat_ws(",", shown).alias("listed"))


@query(
    base="m",
    sql=f"""
WITH {_SEEN},
cp AS (SELECT unnest([180, 240, 300, 360, 420, 480, 600, 720]) AS checkpoint),
live AS (SELECT replay_id, checkpoint, count(*) AS n FROM combat JOIN cp ON time_seconds <= checkpoint GROUP BY ALL),
kept AS (SELECT replay_id, checkpoint FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY replay_id ORDER BY checkpoint) AS before FROM live) WHERE n <> before),
u AS (SELECT *, row_number() OVER (PARTITION BY replay_id, self_owner, side, unit_key ORDER BY time_seconds, display_name, frame) AS n FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY replay_id, self_owner, side, category ORDER BY time_seconds, display_name, frame) AS n FROM v
 WHERE category IN ('worker', 'unit', 'building')),
g AS (SELECT *, time_seconds - lag(time_seconds) OVER (PARTITION BY replay_id ORDER BY time_seconds) AS d FROM combat),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY replay_id ORDER BY time_seconds) AS session FROM g)
SELECT 'checkpoint' AS part, c.replay_id, c.owner, unit_key AS label, CAST(checkpoint AS DOUBLE) AS at_seconds, count(*) AS value
 FROM combat c JOIN kept USING (replay_id) WHERE time_seconds <= checkpoint GROUP BY ALL
UNION ALL SELECT 'milestone', replay_id, self_owner, side || ' unit ' || unit_key, time_seconds, n FROM u WHERE n = 1
UNION ALL SELECT 'milestone', replay_id, self_owner, side || ' category ' || CASE category WHEN 'unit' THEN 'army' ELSE category END, time_seconds, n FROM k WHERE n = 1
UNION ALL SELECT 'session', replay_id, NULL, CAST(CAST(session AS BIGINT) AS VARCHAR), min(time_seconds), count(*) FROM s GROUP BY replay_id, session
UNION ALL SELECT DISTINCT 'unknown_cost', replay_id, NULL, display_name, CAST(NULL AS DOUBLE), 1 FROM combat WHERE NOT known_cost""",
)
def combat_ledger(t: Tables) -> DataFrame:
    """All four parts of every match's loss report, as rows of one shape."""
    events = combat.combat_events(t.corpus.death_events, t.catalog)
    parts = combat.combat_ledger(events, t.corpus.players)
    none, text = F.lit(None), lambda c: F.col(c).cast("string")

    def rows(part, owner, label, at, value):
        return parts[part[0]].select(
            F.lit(part[1]).alias("part"), "replay_id", owner.alias("owner"), label.alias("label"), at.cast("double").alias("at_seconds"),
            value.cast("bigint").alias("value"))

    owner_type = t.corpus.players.schema["owner"].dataType
    return (
        rows(("checkpoints", "checkpoint"), F.col("owner"), F.col("unit_key"), F.col("checkpoint"), F.col("losses"))
        .unionByName(rows(("milestones", "milestone"), F.col("self_owner"), F.concat_ws(" ", "side", "kind", "label"), F.col("time_seconds"), F.col("n")))
        .unionByName(rows(("sessions", "session"), none.cast(owner_type), text("session"), F.col("session_start"), F.col("losses")))
        .unionByName(rows(("unknown_cost", "unknown_cost"), none.cast(owner_type), F.col("display_name"), none, F.lit(1)))
    )
