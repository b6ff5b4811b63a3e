"""Who is looked at: match filters, perspectives, opponents.

Listing self/opponent pairs is one operator (`scope`, `targets`). Aggregates do
not go through pairs: `participants` keeps one row per participant with the
number of pair rows it stands for, so a crowded match never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, ascii_lower_text

K = ["replay_id", "owner"]


def _match_filter(matchup: str | None, map_name: str | None, ids: Sequence | None) -> Column:
    cond = F.lit(True)
    if ids:
        cond = cond & F.col("replay_id").isin(*ids)
    if matchup is not None:
        cond = cond & (F.col("matchup") == matchup)
    if map_name is not None:
        folded = ascii_lower_text(map_name)
        if folded == "unknown":
            cond = cond & (F.col("map").isNull() | (F.trim("map") == ""))
        else:
            cond = cond & (ascii_lower("map") == folded)
    return cond


def _person(name: str | None, race: str | None) -> Column:
    cond = F.lit(True)
    if name is not None:
        cond = cond & (F.col("name_lc") == ascii_lower_text(name))
    if race is not None:
        cond = cond & (F.col("race_lc") == ascii_lower_text(race))
    return cond


def find_matches(
    replays: DataFrame,
    players: DataFrame,
    *,
    matchup: str | None = None,
    player: str | None = None,
    race: str | None = None,
    ids: Sequence | None = None,
    with_players: bool = False,
) -> DataFrame:
    """Matches by matchup, ids, and a participant; name and race must hold on one row.

    `with_players` nests each match's sorted participants; use it where matches are
    known to be small, and join the participants as rows otherwise.
    """
    out = replays.where(_match_filter(matchup, None, ids))
    if player is not None or race is not None:
        out = out.join(players.where(_person(player, race)).select("replay_id"), "replay_id", "left_semi")
    if with_players:
        nested = players.groupBy("replay_id").agg(
            F.array_sort(F.collect_list(F.struct("owner", "name", "race", "zip_path"))).alias("players")
        )
        out = out.join(nested, "replay_id", "left").withColumn(
            "players", F.coalesce("players", F.array().cast("array<struct<owner:int,name:string,race:string,zip_path:string>>"))
        )
    return out


def targets(
    players: DataFrame,
    replays: DataFrame,
    *,
    player: str,
    matchup: str | None = None,
    race: str | None = None,
    ids: Sequence | None = None,
    side: str = "self",
) -> DataFrame:
    """Rows to look up for a player: their own (`self`) or each opponent's (`enemy`)."""
    chosen = players.where(_person(player, race)).select(
        "replay_id", F.col("owner").alias("self_owner"), F.col("name").alias("player_name"), F.col("race").alias("_race")
    )
    matches = replays.where(_match_filter(matchup, None, ids)).select(
        "replay_id", "matchup", "source_replay_filename", "source_replay_path"
    )
    rows = chosen.join(matches, "replay_id")
    if side == "self":
        return rows.select(
            "replay_id",
            "self_owner",
            F.col("self_owner").alias("owner"),
            "player_name",
            F.col("player_name").alias("target_name"),
            F.col("_race").alias("target_race"),
            "matchup",
            "source_replay_filename",
            "source_replay_path",
        )
    if side != "enemy":
        raise ValueError(f"side must be 'self' or 'enemy', not {side!r}")
    enemy = players.select(
        "replay_id", "owner", F.col("name").alias("target_name"), F.col("race").alias("target_race")
    )
    return rows.join(enemy, "replay_id").where(F.col("owner") != F.col("self_owner")).select(
        "replay_id",
        "self_owner",
        "owner",
        "player_name",
        "target_name",
        "target_race",
        "matchup",
        "source_replay_filename",
        "source_replay_path",
    )


def scope(
    replays: DataFrame,
    players: DataFrame,
    *,
    player: str | None = None,
    opponent: str | None = None,
    race: str | None = None,
    opponent_race: str | None = None,
    matchup: str | None = None,
    map_name: str | None = None,
    ids: Sequence | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Self/opponent rows. A match of one keeps a null opponent unless the opponent
    is filtered; a match of more than two gives a row per opponent, or the first
    opponent only with `dedupe`."""
    self_rows = players.where(_person(player, race)).select(
        "replay_id", F.col("owner").alias("self_owner"), F.col("name").alias("player_name"), F.col("race").alias("player_race")
    )
    matches = replays.where(_match_filter(matchup, map_name, ids)).select(
        "replay_id", "matchup", "map", "source_replay_filename", "source_replay_path", "duration_seconds"
    )
    base = matches.join(self_rows, "replay_id")
    other = players.where(_person(opponent, opponent_race)).select(
        F.col("replay_id").alias("_m"),
        F.col("owner").alias("opponent_owner"),
        F.col("name").alias("opponent_name"),
        F.col("race").alias("opponent_race"),
    )
    on = (F.col("replay_id") == F.col("_m")) & (F.col("opponent_owner") != F.col("self_owner"))
    filtered = opponent is not None or opponent_race is not None
    if dedupe:
        # The first opponent of a self row is the smallest matching owner, or the
        # next one when that is the row itself: two rows per match are enough.
        ranked = other.withColumn(
            "_r", F.row_number().over(Window.partitionBy("_m").orderBy("opponent_owner"))
        ).where(F.col("_r") <= 2).drop("_r")
        rows = base.join(ranked, on, "inner" if filtered else "left").drop("_m")
        w = Window.partitionBy("replay_id", "self_owner").orderBy(F.col("opponent_owner").asc_nulls_first())
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return base.join(other, on, "inner" if filtered else "left").drop("_m")


def participants(
    replays: DataFrame,
    players: DataFrame,
    *,
    player: str | None = None,
    opponent: str | None = None,
    race: str | None = None,
    opponent_race: str | None = None,
    matchup: str | None = None,
    map_name: str | None = None,
    ids: Sequence | None = None,
) -> DataFrame:
    """One row per participant seen from either side, without forming pairs.

    `as_self`: how many scope rows have this participant as self (its number of
    matching opponents, or 1 for an unopposed row when opponents are not
    filtered). `as_opponent`: how many have it as the opponent. Both follow
    from two counts per match.
    """
    filtered = opponent is not None or opponent_race is not None
    mine, theirs = _person(player, race), _person(opponent, opponent_race)
    counts = players.groupBy("replay_id").agg(
        F.count_if(mine).alias("_selfs"), F.count_if(theirs).alias("_others")
    )
    matches = replays.where(_match_filter(matchup, map_name, ids)).select(
        "replay_id", "matchup", "map", "source_replay_filename", "duration_seconds"
    )
    is_self, is_other = F.coalesce(mine, F.lit(False)), F.coalesce(theirs, F.lit(False))
    rivals = F.col("_others") - is_other.cast("int")
    as_self = F.when(~is_self, F.lit(0)).when(rivals > 0, rivals).otherwise(F.lit(0 if filtered else 1))
    as_opponent = F.when(is_other, F.col("_selfs") - is_self.cast("int")).otherwise(F.lit(0))
    return (
        players.join(matches.join(counts, "replay_id"), "replay_id")
        .withColumn("as_self", as_self.cast("bigint"))
        .withColumn("as_opponent", as_opponent.cast("bigint"))
        .where((F.col("as_self") > 0) | (F.col("as_opponent") > 0))
        .drop("_selfs", "_others", "zip_path")
    )


def selfs(parts: DataFrame) -> DataFrame:
    """The scope side of `participants`: one row per self participant."""
    return parts.where(F.col("as_self") > 0)


def restrict(fact: DataFrame, keys_of: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Fact rows whose key occurs in the scope."""
    return fact.join(keys_of.select(*keys), list(keys), "left_semi")


def first_opponents(players: DataFrame) -> DataFrame:
    """The two lowest owners per match, enough to find anyone's first opponent."""
    w = Window.partitionBy("replay_id").orderBy("owner")
    return players.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2).select(
        F.col("replay_id").alias("_m"),
        F.col("owner").alias("opponent_owner"),
        F.col("name").alias("opponent_name"),
        F.col("race").alias("opponent_race"),
    )


def perspective(
    players: DataFrame,
    *,
    player: str,
    race: str | None = None,
    last: bool = False,
) -> DataFrame:
    """One row per match the player is in.

    `self_owner`/`enemy_owner`: the first (or last) self row and its first (or
    last) opponent in owner order. `only_self` and `only_self_name` are set only
    when the name fits exactly one participant, `only_enemy` and
    `only_enemy_name` when that one also has exactly one opponent.
    """
    named = F.col("name_lc") == ascii_lower_text(player)
    pick, pick_by = (F.max, F.max_by) if last else (F.min, F.min_by)
    # The name filter reaches the scan; the rest of the table only meets matches it hits.
    chosen = players.where(named & _person(None, race)).groupBy("replay_id").agg(pick("owner").alias("self_owner"))
    rows = players.select("replay_id", "owner", "name", "name_lc").join(chosen, "replay_id")
    other = F.when(F.col("owner") != F.col("self_owner"), F.col("owner"))
    own = F.when(named, F.col("owner"))
    who = rows.groupBy("replay_id", "self_owner").agg(
        pick(other).alias("enemy_owner"),
        pick_by("name", other).alias("_enemy_name"),
        F.count(F.lit(1)).alias("_n"),
        F.count(own).alias("_named"),
        F.max(own).alias("_only"),
        F.max_by("name", own).alias("_only_name"),
    )
    alone = F.col("_named") == 1
    duel = alone & (F.col("_n") == 2)
    return who.select(
        "replay_id",
        "self_owner",
        "enemy_owner",
        F.when(alone, F.col("_only")).alias("only_self"),
        F.when(alone, F.col("_only_name")).alias("only_self_name"),
        F.when(duel, F.col("enemy_owner")).alias("only_enemy"),
        F.when(duel, F.col("_enemy_name")).alias("only_enemy_name"),
    )


def identity(players: DataFrame, player: str, race: str | None = None) -> DataFrame:
    """Self and enemy per match, each null unless exactly one participant fits."""
    return perspective(players, player=player, race=race).select(
        "replay_id",
        F.col("only_self_name").alias("self_player_name"),
        F.col("only_self").alias("self_owner"),
        F.col("only_enemy_name").alias("enemy_player_name"),
        F.col("only_enemy").alias("enemy_owner"),
    )


def in_matches(replays: DataFrame, who: DataFrame, *, matchup: str | None = None, ids: Sequence | None = None) -> DataFrame:
    """Match columns of the matches in `who`, filtered."""
    kept = replays.where(_match_filter(matchup, None, ids)).select(
        "replay_id", "source_replay_filename", "source_replay_path", "matchup"
    )
    return kept.join(who, "replay_id")
