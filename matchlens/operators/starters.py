"""Starter reports over a corpus, one function for each topic.

Items, races and units compare without ASCII case, matchups exactly. Reports
are complete; `limit` keeps the first rows of a report's own order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_text
from ..schema import Corpus

K = ["replay_id", "owner"]


def _ordered(df: DataFrame, limit: int | None, *keys: Column | str) -> DataFrame:
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def _people(c: Corpus) -> DataFrame:
    """Every participant beside the columns of the match."""
    matches = c.replays.select("replay_id", "source_replay_filename", "matchup", "map", "duration_seconds")
    return c.players.select(*K, "name", "race", "race_lc").join(matches, "replay_id")


def _numbered(c: Corpus, item: str, n: int, time_name: str) -> DataFrame:
    """Time of each participant's n-th event of an item."""
    rows = c.build_order_events.where(F.col("item_lc") == ascii_lower_text(item)).select(*K, "time_seconds", "event_seq")
    place = F.row_number().over(Window.partitionBy(*K).orderBy("time_seconds", "event_seq"))
    return rows.withColumn("_n", place).where(F.col("_n") == n).select(*K, F.col("time_seconds").alias(time_name))


def _latest(samples: DataFrame, keys: Sequence[str], at: float) -> DataFrame:
    """The last row of each key at or before a time."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("time_seconds"), F.desc("frame")))
    return samples.where(F.col("time_seconds") <= at).withColumn("_n", place).where("_n = 1").drop("_n")


def players(c: Corpus, limit: int | None = None) -> DataFrame:
    out = c.players.groupBy("name", "race").agg(F.count("*").alias("player_rows"))
    return _ordered(out, limit, F.desc("player_rows"), "name", "race")


def matchups(c: Corpus, limit: int | None = None) -> DataFrame:
    return _ordered(c.replays.groupBy("matchup").agg(F.count("*").alias("replay_count")), limit, F.desc("replay_count"), "matchup")


def build_items(c: Corpus, limit: int | None = None) -> DataFrame:
    """Items by race: events, and participants that have any."""
    own = c.build_order_events.groupBy(*K, "item").agg(F.count("*").alias("n")).join(c.players.select(*K, "race"), K)
    out = own.groupBy("race", "item").agg(F.sum("n").alias("event_count"), F.count("*").alias("player_replay_count"))
    return _ordered(out, limit, F.desc("player_replay_count"), F.desc("event_count"), "item", "race")


def first_occurrence(c: Corpus, item: str = "Spire", race: str = "zerg", matchup: str = "ZvT", limit: int | None = None) -> DataFrame:
    who = _people(c).where((F.col("race_lc") == ascii_lower_text(race)) & (F.col("matchup") == matchup))
    out = _numbered(c, item, 1, "time_seconds").join(who, K)
    return _ordered(
        out.select("source_replay_filename", "matchup", "name", "race", "owner", "replay_id", "time_seconds"), limit, "time_seconds", "replay_id", "owner")


def nth_occurrence(c: Corpus, item: str = "Hatchery", n: int = 3, limit: int | None = None) -> DataFrame:
    out = _numbered(c, item, n, "time_seconds").join(_people(c), K)
    return _ordered(out.select("source_replay_filename", "name", "replay_id", "owner", "time_seconds"), limit, "time_seconds", "replay_id", "owner")


def event_sequence(c: Corpus, item: str = "Hatchery", n: int = 3, then: str = "Spire", limit: int | None = None) -> DataFrame:
    """Participants whose n-th event of an item comes before their first one of another."""
    both = _numbered(c, item, n, "nth_seconds").join(_numbered(c, then, 1, "first_seconds"), K).where("nth_seconds < first_seconds")
    out = both.join(_people(c), K).withColumn("delta_seconds", F.col("first_seconds") - F.col("nth_seconds"))
    return _ordered(out, limit, "delta_seconds", "replay_id", "name").select(
        "name", "source_replay_filename", "nth_seconds", "first_seconds", "delta_seconds")


def economy_at(c: Corpus, at: float = 300, limit: int | None = None) -> DataFrame:
    out = _latest(c.economy_samples, K, at).join(_people(c), K)
    return _ordered(
        out.select("name", "source_replay_filename", "time_seconds", "workers", "minerals", "gas"), limit, "name", "source_replay_filename", "time_seconds")


def unit_counts_at(c: Corpus, units: Sequence[str] = ("mutalisk", "drone", "zergling"), at: float = 420, limit: int | None = None) -> DataFrame:
    some = c.unit_count_samples.where(F.col("unit_type_lc").isin([ascii_lower_text(u) for u in units]))
    out = _latest(some, [*K, "unit_type"], at).join(_people(c), K)
    return _ordered(out.select("name", "source_replay_filename", "unit_type", "count"), limit, "name", "source_replay_filename", "unit_type", "count")


def deaths_window(c: Corpus, lo: float = 420, hi: float = 540, limit: int | None = None) -> DataFrame:
    rows = c.death_events.where(F.col("time_seconds").between(lo, hi)).groupBy(*K, "unit_type").agg(F.count("*").alias("n"))
    out = rows.join(_people(c), K).groupBy("name", "race", "matchup", "unit_type").agg(F.sum("n").alias("death_count"))
    return _ordered(out, limit, F.desc("death_count"), "unit_type", "name", "race", "matchup")


def card(c: Corpus, name_part: str = "game", limit: int | None = None) -> DataFrame:
    """Matches whose file name holds a text, a row for each participant."""
    found = _people(c).where(F.instr(ascii_lower("source_replay_filename"), ascii_lower_text(name_part)) > 0)
    return _ordered(
        found.select("replay_id", "source_replay_filename", "matchup", "map", "duration_seconds", "owner", "name", "race"),
        limit, "source_replay_filename", "owner")


STARTERS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (players, matchups, build_items, first_occurrence, nth_occurrence, event_sequence, economy_at, unit_counts_at, deaths_window, card)
}
