"""Match cards: anchors, worker benchmarks and losses for every participant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower_text, clock
from ..schema import Corpus
from .asof import latest_when
from .events import first_opponent_of
from .pattern import loss_facts
from .scope import K, participants, selfs

# Items whose first start a card lists, by race and in order.
ANCHORS = {
    "zerg": ("Hatchery", "Spawning Pool", "Extractor", "Lair", "Spire", "Hydralisk Den", "Evolution Chamber", "Hive"),
    "terran": (
        "Supply Depot", "Barracks", "Refinery", "Factory", "Academy", "Engineering Bay", "Starport", "Science Facility"
    ),
    "protoss": (
        "Pylon", "Gateway", "Forge", "Assimilator", "Cybernetics Core", "Citadel of Adun", "Stargate", "Robotics Facility"
    ),
}
ECONOMY_TIMES = (300, 420)
LOSS_WINDOWS = ((420, 540),)


def match_card(
    corpus: Corpus,
    *,
    player: str | None = None,
    ids: Sequence | None = None,
    filename_contains: str | None = None,
    anchors: dict[str, Sequence[str]] = ANCHORS,
    economy_times: Sequence[int] = ECONOMY_TIMES,
    windows: Sequence[tuple[int, int]] = LOSS_WINDOWS,
) -> DataFrame:
    """One card per participant, against its first opponent.

    Three scans, each an aggregate per participant. Anchors depend on the race;
    an anchor the participant never started is left out.
    """
    parts = selfs(participants(corpus.replays, corpus.players, player=player, ids=ids))
    if filename_contains:
        parts = parts.where(F.instr(F.lower("source_replay_filename"), filename_contains.lower()) > 0)
    cards = first_opponent_of(parts, corpus.players)

    wanted = sorted({ascii_lower_text(i) for items in anchors.values() for i in items})
    firsts = (
        corpus.build_order_events.where(F.col("item_lc").isin(*wanted))
        .groupBy(*K, "item_lc").agg(F.min("time_seconds").alias("t"))
        .groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct("item_lc", "t"))).alias("_firsts"))
    )
    eco = corpus.economy_samples.where(F.col("time_seconds") <= max(economy_times)).groupBy(*K).agg(
        *[
            latest_when(F.col("time_seconds") <= t, ["workers"], ["time_seconds", "frame"]).alias(f"_eco{t}")
            for t in economy_times
        ]
    )
    names = {(float(lo), float(hi)): f"_w{i}" for i, (lo, hi) in enumerate(windows)}
    losses = loss_facts(corpus.death_events, names)
    mine = losses.withColumnsRenamed({n: f"_own{n}" for n in names.values()})
    theirs = losses.withColumnRenamed("owner", "opponent_owner").withColumnsRenamed({n: f"_opp{n}" for n in names.values()})

    out = (
        cards.join(firsts, K, "left")
        .join(eco, K, "left")
        .join(mine, K, "left")
        .join(theirs, ["replay_id", "opponent_owner"], "left")
    )
    listed = F.array().cast("array<struct<item:string,n:int,time:string>>")
    for race, items in anchors.items():
        entries = F.array(
            *[
                F.when(
                    F.col("_firsts")[ascii_lower_text(i)].isNotNull(),
                    F.struct(F.lit(i).alias("item"), F.lit(1).alias("n"), clock(F.col("_firsts")[ascii_lower_text(i)]).alias("time")),
                )
                for i in items
            ]
        )
        listed = F.when(F.col("race_lc") == race, F.filter(entries, lambda x: x.isNotNull())).otherwise(listed)
    empty = F.create_map().cast("map<string,bigint>")
    bench = F.array(
        *[
            F.struct(clock(F.lit(t)).alias("time"), F.col(f"_eco{t}")["workers"].alias("workers"))
            for t in economy_times
        ]
    )
    fights = F.array(
        *[
            F.struct(
                F.concat(clock(F.lit(lo)), F.lit("-"), clock(F.lit(hi))).alias("window"),
                F.coalesce(F.col(f"_own{n}")["count_by_unit_type"], empty).alias("lost"),
                F.coalesce(F.col(f"_opp{n}")["count_by_unit_type"], empty).alias("killed"),
            )
            for (lo, hi), n in names.items()
        ]
    )
    return out.select(
        *K,
        F.col("source_replay_filename").alias("filename"),
        F.coalesce("map", F.lit("unknown")).alias("map"),
        clock("duration_seconds").alias("duration"),
        "name",
        "race",
        "opponent_owner",
        "opponent_name",
        "opponent_race",
        "matchup",
        listed.alias("build_anchors"),
        bench.alias("economy_benchmarks"),
        fights.alias("combat_summary"),
    )
