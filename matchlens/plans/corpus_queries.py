"""Queries over matches: scope, discovery, samples, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matchup_text
from ..operators import discovery, losses, quality, samples, scope
from .adapters import Tables
from .event_queries import PLAYER
from .registry import long_summary, query, summary_sql

K = ["replay_id", "owner"]


@query(
    base="m",
    sql=f"""
SELECT r.replay_id, r.source_replay_filename, r.matchup, r.map, count(p.owner) AS player_count FROM replays r JOIN players p USING (replay_id)
WHERE r.matchup = '5-LOW' AND EXISTS (SELECT 1 FROM players q WHERE q.replay_id = r.replay_id AND q.name = '{PLAYER}') GROUP BY ALL""",
)
def find_replays(t: Tables) -> DataFrame:
    c = t.corpus
    found = scope.find_matches(c.replays, c.players, matchup="5-LOW", player=PLAYER.lower())
    sizes = c.players.groupBy("replay_id").agg(F.count(F.lit(1)).alias("player_count"))
    return found.join(sizes, "replay_id").select("replay_id", "source_replay_filename", "matchup", "map", "player_count")


@query(
    base="m",
    sql="SELECT replay_id, matchup FROM replays r WHERE EXISTS (SELECT 1 FROM players p WHERE p.replay_id = r.replay_id AND p.race = 'NATION_3') AND matchup = '2-HIGH'",
)
def find_replays_by_race(t: Tables) -> DataFrame:
    c = t.corpus
    return scope.find_matches(c.replays, c.players, matchup="2-HIGH", race="nation_3").select("replay_id", "matchup")


@query(
    base="m",
    sql=f"""
SELECT replay_id, self_owner, player_name, opponent_owner, opponent_name, map, duration_seconds FROM pairs
WHERE player_name = '{PLAYER}' AND opponent_race = 'NATION_5' AND map IS NULL""",
)
def scope_with_opponent(t: Tables) -> DataFrame:
    c = t.corpus
    rows = scope.scope(c.replays, c.players, player=PLAYER, opponent_race="Nation_5", map_name="Unknown")
    return rows.select("replay_id", "self_owner", "player_name", "opponent_owner", "opponent_name", "map", "duration_seconds")


@query(
    base="m",
    sql="SELECT replay_id, self_owner, min(opponent_owner) AS opponent_owner FROM pairs WHERE matchup = '3-MEDIUM' GROUP BY ALL",
)
def scope_deduped(t: Tables) -> DataFrame:
    c = t.corpus
    return scope.scope(c.replays, c.players, matchup="3-MEDIUM", dedupe=True).select("replay_id", "self_owner", "opponent_owner")


@query(
    base="m",
    sql="""
WITH s AS (SELECT replay_id, self_owner AS owner, count(*) AS n FROM pairs WHERE player_race = 'NATION_1' AND opponent_race = 'NATION_2' GROUP BY ALL),
o AS (SELECT replay_id, opponent_owner AS owner, count(*) AS n FROM pairs WHERE player_race = 'NATION_1' AND opponent_race = 'NATION_2' GROUP BY ALL)
SELECT replay_id, owner, coalesce(s.n, 0) AS as_self, coalesce(o.n, 0) AS as_opponent FROM s FULL JOIN o USING (replay_id, owner)""",
)
def participant_weights(t: Tables) -> DataFrame:
    c = t.corpus
    return scope.participants(c.replays, c.players, race="nation_1", opponent_race="nation_2").select(*K, "as_self", "as_opponent")


@query(
    base="m",
    sql=f"""
WITH n AS (SELECT replay_id, count(*) AS c FROM players GROUP BY ALL)
SELECT s.replay_id, s.name AS self_player_name, s.owner AS self_owner, e.name AS enemy_player_name, e.owner AS enemy_owner
FROM players s JOIN n ON n.replay_id = s.replay_id LEFT JOIN players e ON e.replay_id = s.replay_id AND e.owner <> s.owner AND n.c = 2
WHERE s.name = '{PLAYER}'""",
)
def identity_unique_opponent(t: Tables) -> DataFrame:
    return scope.identity(t.corpus.players, PLAYER)


@query(
    base="m",
    sql="""
WITH d AS (SELECT DISTINCT replay_id, self_owner, coalesce(matchup, 'unknown') AS matchup, coalesce(map, 'unknown') AS map, player_race AS race, player_name FROM pairs)
SELECT 'matchup' AS dimension, matchup AS value, count(DISTINCT replay_id) AS match_count, count(*) AS player_rows FROM d GROUP BY matchup
UNION ALL SELECT 'map', map, count(DISTINCT replay_id), count(*) FROM d GROUP BY map
UNION ALL SELECT 'race', race, count(DISTINCT replay_id), count(*) FROM d GROUP BY race
UNION ALL SELECT 'all', 'all', count(DISTINCT replay_id), count(*) FROM d
UNION ALL SELECT 'players', 'all', count(DISTINCT lower(player_name)), count(*) FROM d""",
)
def corpus_summary_counts(t: Tables) -> DataFrame:
    c = t.corpus
    return discovery.corpus_summary(scope.participants(c.replays, c.players))


@query(
    base="m",
    sql="""
WITH d AS (SELECT DISTINCT replay_id, self_owner, matchup, player_race AS race, player_name FROM pairs)
SELECT player_name AS name, count(DISTINCT replay_id) AS match_count, string_agg(DISTINCT race, ',' ORDER BY race) AS races,
  max(top) AS top_matchup FROM d JOIN (SELECT player_name AS pn, arg_min(matchup, (-c, matchup)) AS top FROM
   (SELECT player_name, matchup, count(DISTINCT replay_id) AS c FROM d GROUP BY ALL) GROUP BY pn) ON pn = player_name
GROUP BY player_name""",
)
def list_players(t: Tables) -> DataFrame:
    c = t.corpus
    out = discovery.list_players(scope.participants(c.replays, c.players))
    return out.select("name", "match_count", F.array_join("races", ",").alias("races"), F.col("matchups")[0]["matchup"].alias("top_matchup"))


@query(
    base="m",
    sql="""SELECT coalesce(matchup, 'unknown') AS matchup, count(DISTINCT replay_id) AS match_count, count(*) AS player_rows
FROM (SELECT DISTINCT replay_id, self_owner, matchup FROM pairs WHERE opponent_race = 'NATION_7') GROUP BY 1""",
)
def list_matchups(t: Tables) -> DataFrame:
    c = t.corpus
    return discovery.list_matchups(scope.participants(c.replays, c.players, opponent_race="nation_7"))


ITEMS = "SELECT item AS name, count(*) AS event_count, count(DISTINCT replay_id) AS match_count FROM build_order_events b"


@query(
    base="m",
    sql=ITEMS + " WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.replay_id = b.replay_id AND p.self_owner = b.owner AND p.player_race = 'NATION_2') GROUP BY item",
)
def list_items(t: Tables) -> DataFrame:
    c = t.corpus
    return discovery.list_items(c.build_order_events, scope.participants(c.replays, c.players, race="NATION_2"))


@query(base="m", sql=ITEMS + " WHERE lower(item) LIKE '%m%' GROUP BY item")
def search_items(t: Tables) -> DataFrame:
    c = t.corpus
    return discovery.search_items(c.build_order_events, scope.participants(c.replays, c.players), " M ")


@query(
    base="m",
    sql="""
WITH s AS (SELECT DISTINCT replay_id, self_owner AS owner FROM pairs WHERE matchup = '1-URGENT'),
a AS (SELECT unit_type, count(*) AS n FROM unit_count_samples JOIN s USING (replay_id, owner) GROUP BY ALL),
b AS (SELECT unit_type, count(*) AS n FROM death_events JOIN s USING (replay_id, owner) GROUP BY ALL)
SELECT unit_type AS name, coalesce(a.n, 0) AS unit_count_sample_count, coalesce(b.n, 0) AS death_event_count FROM a FULL JOIN b USING (unit_type)""",
)
def list_unit_types_both(t: Tables) -> DataFrame:
    c = t.corpus
    parts = scope.participants(c.replays, c.players, matchup="1-URGENT")
    return discovery.list_units(c.unit_count_samples, c.death_events, parts)


@query(
    base="m",
    sql="""
SELECT 'build_order_events' AS table_name, count(*) > 0 AS has_rows FROM build_order_events JOIN replays USING (replay_id) WHERE matchup = '2-HIGH'
UNION ALL SELECT 'death_events', count(*) > 0 FROM death_events JOIN replays USING (replay_id) WHERE matchup = '2-HIGH'
UNION ALL SELECT 'supply_samples', count(*) > 0 FROM supply_samples JOIN replays USING (replay_id) WHERE matchup = '2-HIGH'""",
)
def data_availability(t: Tables) -> DataFrame:
    c = t.corpus
    parts = scope.participants(c.replays, c.players, matchup="2-HIGH")
    return discovery.availability(parts, {n: getattr(c, n) for n in ("build_order_events", "death_events", "supply_samples")})


@query(
    base="m",
    sql="""
WITH e AS (SELECT DISTINCT l_orderkey AS replay_id, l_suppkey AS owner FROM lineitem)
SELECT 'economy_samples' AS table_name, count(*) FILTER (p.owner IS NULL) AS orphan_rows FROM economy_samples s LEFT JOIN (SELECT * FROM players WHERE race <> 'NATION_4') p USING (replay_id, owner)
UNION ALL SELECT 'death_events', count(*) FILTER (p.owner IS NULL) FROM death_events s LEFT JOIN (SELECT * FROM players WHERE race <> 'NATION_4') p USING (replay_id, owner)""",
)
def orphan_rows(t: Tables) -> DataFrame:
    c = t.corpus
    known = c.players.where(F.col("race") != "NATION_4")
    return quality.orphans({"economy_samples": c.economy_samples, "death_events": c.death_events}, known)


@query(
    base="m",
    sql="""SELECT replay_id, string_agg(upper(substr(race, 1, 1)), 'v' ORDER BY owner, race) AS matchup FROM players GROUP BY replay_id""",
)
def matchup_string(t: Tables) -> DataFrame:
    per = t.corpus.players.groupBy("replay_id").agg(F.collect_list(F.struct("owner", "race")).alias("p"))
    return per.select("replay_id", matchup_text("p").alias("matchup"))


# Samples.

LATEST = "row_number() OVER (PARTITION BY {k} ORDER BY time_seconds DESC, frame DESC) AS rn"


@query(
    base="m",
    sql=f"""
WITH e AS (SELECT *, {LATEST.format(k='replay_id, owner')} FROM economy_samples WHERE time_seconds <= 900)
SELECT p.replay_id, p.owner, e.time_seconds, e.minerals, e.workers FROM players p LEFT JOIN e ON e.replay_id = p.replay_id AND e.owner = p.owner AND rn = 1
WHERE p.name = '{PLAYER}'""",
)
def asof_const_economy(t: Tables) -> DataFrame:
    c = t.corpus
    out = samples.economy_at(c.economy_samples, scope.targets(c.players, c.replays, player=PLAYER), 900)
    s = F.col("sample")
    return out.select(*K, s["time_seconds"].alias("time_seconds"), s["minerals"].alias("minerals"), s["workers"].alias("workers"))


@query(
    base="m",
    sql=f"""
WITH e AS (SELECT *, {LATEST.format(k='replay_id, owner')} FROM unit_count_samples WHERE time_seconds <= 900 AND unit_type = 'PROMO')
SELECT p.replay_id, p.owner, e.time_seconds, e.count FROM players p LEFT JOIN e ON e.replay_id = p.replay_id AND e.owner = p.owner AND rn = 1
WHERE p.name = '{PLAYER}'""",
)
def unit_count_at(t: Tables) -> DataFrame:
    c = t.corpus
    out = samples.unit_count_at(c.unit_count_samples, scope.targets(c.players, c.replays, player=PLAYER), "promo", 900)
    s = F.col("sample")
    return out.select(*K, s["time_seconds"].alias("time_seconds"), s["count"].alias("count"))


COMPOSITION = f"""
WITH e AS (SELECT *, {LATEST.format(k='replay_id, owner, unit_type')} FROM unit_count_samples WHERE time_seconds <= 900)
SELECT unit_type AS unit, {summary_sql('e.count')} FROM pairs p JOIN e ON e.replay_id = p.replay_id AND e.owner = p.self_owner AND rn = 1
"""


@query(base="m", sql=COMPOSITION + "WHERE p.matchup = '4-NOT SPECIFIED' AND unit_type IN ('PROMO', 'SMALL') GROUP BY unit_type")
def composition_snapshot(t: Tables) -> DataFrame:
    c = t.corpus
    parts = scope.participants(c.replays, c.players, matchup="4-NOT SPECIFIED")
    out = samples.composition_snapshot(c.unit_count_samples, parts, 900, ["PROMO", "SMALL", " "])
    return long_summary(out, "unit")


@query(
    base="m",
    sql=COMPOSITION.replace("WITH e AS", """WITH top AS (SELECT unit_type, count(*) AS n FROM unit_count_samples u
 WHERE time_seconds <= 900 AND EXISTS (SELECT 1 FROM pairs p WHERE p.replay_id = u.replay_id AND p.self_owner = u.owner AND p.player_race = 'NATION_6')
 GROUP BY unit_type ORDER BY n DESC, lower(unit_type) LIMIT 3), e AS""")
    + "JOIN top USING (unit_type) WHERE p.player_race = 'NATION_6' GROUP BY unit_type",
)
def composition_default_units(t: Tables) -> DataFrame:
    c = t.corpus
    parts = scope.participants(c.replays, c.players, race="NATION_6")
    return long_summary(samples.composition_snapshot(c.unit_count_samples, parts, 900, top=3), "unit")


@query(
    base="m",
    sql=f"""
WITH e AS (SELECT *, {LATEST.format(k='replay_id, owner')} FROM economy_samples WHERE time_seconds <= 1200),
rows_ AS (SELECT e.* FROM pairs p JOIN e ON e.replay_id = p.replay_id AND e.owner = p.self_owner AND rn = 1)
SELECT 'workers' AS measure, {summary_sql('workers')} FROM rows_ UNION ALL SELECT 'minerals', {summary_sql('minerals')} FROM rows_
UNION ALL SELECT 'gas', {summary_sql('gas')} FROM rows_""",
)
def economy_distribution(t: Tables) -> DataFrame:
    c = t.corpus
    return long_summary(samples.economy_distribution(c.economy_samples, scope.participants(c.replays, c.players), 1200), "measure")


@query(
    base="m",
    sql="""
WITH e AS (SELECT replay_id, owner, arg_max(minerals, (time_seconds, frame)) FILTER (time_seconds <= 900) AS m1, arg_min(minerals, (time_seconds, frame)) AS m0 FROM economy_samples GROUP BY ALL),
s AS (SELECT replay_id, owner, arg_max(current, (time_seconds, frame)) FILTER (time_seconds <= 900) AS c1, arg_min(current, (time_seconds, frame)) AS c0 FROM supply_samples GROUP BY ALL),
at_ AS (SELECT replay_id, owner, coalesce(max(time_seconds) FILTER (time_seconds <= 900), min(time_seconds)) AS t FROM unit_count_samples GROUP BY ALL),
u AS (SELECT c.replay_id, c.owner, sum(n) AS units FROM (SELECT replay_id, owner, time_seconds, unit_type, arg_max(count, frame) AS n FROM unit_count_samples GROUP BY ALL) c
  JOIN at_ ON at_.replay_id = c.replay_id AND at_.owner = c.owner AND at_.t = c.time_seconds GROUP BY ALL)
SELECT replay_id, owner, coalesce(m1, m0) AS minerals, coalesce(c1, c0) AS supply_current, CAST(units AS BIGINT) AS units FROM e JOIN s USING (replay_id, owner) JOIN u USING (replay_id, owner)""",
)
def state_at(t: Tables) -> DataFrame:
    c = t.corpus
    out = samples.state_at(c.economy_samples, c.supply_samples, c.unit_count_samples, 900)
    units = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(*K, "minerals", "supply_current", units.alias("units"))


@query(
    base="m",
    sql="""
WITH cp AS (SELECT unnest([180, 240, 300, 360, 420, 480, 600, 720]) AS checkpoint),
last_ AS (SELECT replay_id, owner, max(time_seconds) AS last_t FROM unit_count_samples GROUP BY ALL),
at_ AS (SELECT u.replay_id, u.owner, checkpoint, max(time_seconds) AS t FROM unit_count_samples u JOIN last_ l ON l.replay_id = u.replay_id AND l.owner = u.owner
  JOIN cp ON time_seconds <= checkpoint AND checkpoint <= last_t GROUP BY ALL)
SELECT u.replay_id, u.owner, checkpoint, lower(unit_type) AS unit_key, count, CASE WHEN unit_type = 'PROMO' THEN 'Promo' ELSE unit_type END AS display_name,
 CASE WHEN unit_type = 'PROMO' THEN 10 WHEN c.type = 'Unit' THEN 3 ELSE 8 END AS category_rank
FROM unit_count_samples u JOIN at_ ON at_.replay_id = u.replay_id AND at_.owner = u.owner AND at_.t = u.time_seconds LEFT JOIN catalog c ON c.name = u.unit_type""",
)
def checkpoint_composition(t: Tables) -> DataFrame:
    return samples.checkpoint_composition(t.corpus.unit_count_samples, t.catalog).select(
        *K, "checkpoint", "unit_key", "count", "display_name", "category_rank"
    )


# Losses.

@query(
    base="m",
    sql=f"""
SELECT p.replay_id, p.owner, d.time_seconds, d.unit_type, d.category FROM players p
LEFT JOIN death_events d ON d.replay_id = p.replay_id AND d.owner = p.owner AND d.time_seconds BETWEEN 600 AND 1200 WHERE p.name = '{PLAYER}'""",
)
def deaths_between(t: Tables) -> DataFrame:
    c = t.corpus
    return losses.losses_between(c.death_events, scope.targets(c.players, c.replays, player=PLAYER), 600, 1200).select(
        *K, "time_seconds", "unit_type", "category"
    )


@query(
    base="m",
    sql="""
WITH sc AS (SELECT * FROM pairs WHERE matchup = '2-HIGH'), n AS (SELECT count(*) AS n FROM sc),
d AS (SELECT * FROM death_events WHERE time_seconds BETWEEN 600 AND 1200),
lost AS (SELECT 'lost' AS side, unit_type AS unit, count(*) AS count FROM sc JOIN d ON d.replay_id = sc.replay_id AND d.owner = sc.self_owner GROUP BY ALL),
killed AS (SELECT 'killed' AS side, unit_type AS unit, count(*) AS count FROM sc JOIN d ON d.replay_id = sc.replay_id AND d.owner = sc.opponent_owner GROUP BY ALL)
SELECT side, unit, count, n.n AS sample_size, round(count / n.n, 2) AS per_match_mean FROM (SELECT * FROM lost UNION ALL SELECT * FROM killed), n""",
)
def death_summary_lost_killed(t: Tables) -> DataFrame:
    c = t.corpus
    return losses.death_summary(c.death_events, scope.participants(c.replays, c.players, matchup="2-HIGH"), 600, 1200)


@query(
    base="m",
    sql="""
WITH u AS (SELECT replay_id, owner, unit_type AS k, count(*) AS c FROM death_events GROUP BY ALL),
c AS (SELECT replay_id, owner, category AS k, count(*) AS c FROM death_events GROUP BY ALL)
SELECT replay_id, owner, count(*) AS total_count, min(time_seconds) AS first_time, max(time_seconds) AS last_time,
 (SELECT string_agg(k || '=' || c, ',' ORDER BY k) FROM u WHERE u.replay_id = d.replay_id AND u.owner = d.owner) AS by_unit,
 (SELECT string_agg(k || '=' || c, ',' ORDER BY k) FROM c WHERE c.replay_id = d.replay_id AND c.owner = d.owner) AS by_category
FROM death_events d GROUP BY replay_id, owner""",
)
def death_histograms(t: Tables) -> DataFrame:
    text = lambda m: F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    out = losses.loss_histograms(t.corpus.death_events)
    return out.select(*K, "total_count", "first_time", "last_time", text("by_unit_type").alias("by_unit"), text("by_category").alias("by_category"))



