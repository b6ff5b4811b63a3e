"""What is in the corpus: players, matchups, items, units, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_text
from .scope import K, restrict, selfs


def corpus_summary(parts: DataFrame) -> DataFrame:
    """Long rows (dimension, value, matches, participants) from one grouping-sets pass.

    Dimensions: `all` (value null), `matchup`, `map`, `race`, and `player`
    folded to a count of distinct names under `all_players`.
    """
    rows = selfs(parts).select(
        "replay_id",
        "owner",
        F.coalesce("matchup", F.lit("unknown")).alias("matchup"),
        F.when(F.trim("map") != "", F.col("map")).otherwise("unknown").alias("map"),
        "race",
        "name_lc",
    )
    # A match has one matchup and one map, so its rows shrink to one per race before they are dealt by dimension.
    per_race = rows.groupBy("replay_id", "matchup", "map", "race").agg(F.count(F.lit(1)).alias("c"))
    # At most one entry per race of the match.
    per_match = per_race.groupBy("replay_id", "matchup", "map").agg(
        F.sum("c").alias("c"), F.collect_list(F.struct(F.lit("race").alias("dimension"), F.col("race").alias("value"), "c")).alias("races"))
    whole = F.array(*[
        F.struct(F.lit(d).alias("dimension"), v.alias("value"), F.col("c"))
        for d, v in (("matchup", F.col("matchup")), ("map", F.col("map")), ("all", F.lit("all")))])
    sized = per_match.select(F.inline(F.concat(whole, "races"))).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("match_count"), F.sum("c").alias("player_rows")
    )
    names = rows.groupBy("name_lc").agg(F.count(F.lit(1)).alias("c")).agg(
        F.lit("players").alias("dimension"),
        F.lit("all").alias("value"),
        F.count(F.lit(1)).alias("match_count"),
        F.sum("c").alias("player_rows"),
    )
    return sized.unionByName(names.withColumn("player_rows", F.coalesce("player_rows", F.lit(0))))


def availability(parts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Whether each fact table has any row for a match in scope."""
    ids = selfs(parts).select("replay_id").distinct()
    out = None
    for name, df in tables.items():
        hit = df.select("replay_id").join(ids, "replay_id", "left_semi").limit(1)
        row = hit.agg((F.count(F.lit(1)) > 0).alias("has_rows")).select(F.lit(name).alias("table_name"), "has_rows")
        out = row if out is None else out.unionByName(row)
    return out


def list_players(parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Players by distinct matches: display name, races seen, counts per matchup."""
    rows = selfs(parts)
    cells = rows.groupBy("name_lc", F.coalesce("matchup", F.lit("unknown")).alias("matchup"), "replay_id").agg(
        F.min_by("name", F.struct("replay_id", "owner")).alias("name"),
        F.min(F.struct("replay_id", "owner")).alias("at"),
        F.collect_set("race").alias("races"),
    )
    # A match has one matchup, so distinct matches add up over matchups.
    per_matchup = cells.groupBy("name_lc", "matchup").agg(
        F.count(F.lit(1)).alias("c"),
        F.min_by("name", "at").alias("name"),
        F.min("at").alias("at"),
        F.array_distinct(F.flatten(F.collect_set("races"))).alias("races"),
    )
    out = per_matchup.groupBy("name_lc").agg(
        F.min_by("name", "at").alias("name"),
        F.sum("c").alias("match_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("races")))).alias("races"),
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "matchup", "c"))),
            lambda s: F.struct(s["matchup"].alias("matchup"), s["c"].alias("match_count")),
        ).alias("matchups"),
    ).drop("name_lc")
    ranked = out.orderBy(F.col("match_count").desc(), "name")
    return ranked if limit is None else ranked.limit(limit)


def list_matchups(parts: DataFrame, limit: int | None = None) -> DataFrame:
    per_match = selfs(parts).groupBy(F.coalesce("matchup", F.lit("unknown")).alias("matchup"), "replay_id").agg(
        F.count(F.lit(1)).alias("c")
    )
    out = per_match.groupBy("matchup").agg(
        F.count(F.lit(1)).alias("match_count"), F.sum("c").alias("player_rows")
    ).orderBy(F.col("match_count").desc(), "matchup")
    return out if limit is None else out.limit(limit)


def list_items(events: DataFrame, parts: DataFrame, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Items by distinct matches, case-folded, optionally containing a text."""
    rows = events.select(*K, "item", "item_lc")
    if query is not None:
        rows = rows.where(F.instr(F.col("item_lc"), ascii_lower_text(query.strip())) > 0) if query.strip() else rows
    per_match = restrict(rows, selfs(parts)).groupBy("item_lc", "replay_id").agg(
        F.count(F.lit(1)).alias("c"), F.min("item").alias("name")
    )
    out = (
        per_match.groupBy("item_lc")
        .agg(F.min("name").alias("name"), F.sum("c").alias("event_count"), F.count(F.lit(1)).alias("match_count"))
        .orderBy(F.col("match_count").desc(), "item_lc")
        .drop("item_lc")
    )
    return out if limit is None else out.limit(limit)


def search_items(events: DataFrame, parts: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    return list_items(events, parts, query, limit)


def list_units(
    counts: DataFrame, deaths: DataFrame, parts: DataFrame, source: str = "both", limit: int | None = None
) -> DataFrame:
    """Unit types by rows in the count samples and in the deaths.

    Names fold by case inside each table and merge exactly across the two.
    """
    if source not in ("both", "unit_counts", "deaths"):
        raise ValueError(f"unknown source {source!r}")
    one, none = F.count(F.lit(1)), F.lit(0).cast("bigint")

    def per_unit(fact: DataFrame, counted: str, zero: str) -> DataFrame:
        return (
            restrict(fact.select(*K, "unit_type"), selfs(parts))
            .groupBy(ascii_lower("unit_type").alias("_u"))
            .agg(F.min("unit_type").alias("unit_type"), one.alias(counted))
            .select("unit_type", counted, none.alias(zero))
        )

    sides = []
    if source != "deaths":
        sides.append(per_unit(counts, "a", "b"))
    if source != "unit_counts":
        sides.append(per_unit(deaths, "b", "a"))
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    out = rows.groupBy(F.col("unit_type").alias("name")).agg(
        F.sum("a").alias("unit_count_sample_count"), F.sum("b").alias("death_event_count")
    ).orderBy((F.col("unit_count_sample_count") + F.col("death_event_count")).desc(), "name")
    return out if limit is None else out.limit(limit)
