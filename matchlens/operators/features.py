"""Feature matrix: one wide row per participant, generated from a compact spec.

Columns follow a few patterns (count of a unit at minute m, time of the k-th
start of an item, ...), so the 722 names are derived from the rules below. The
table is computed long and narrow, one (participant, feature, value) row per
value that exists, and gathered into columns at the end: two scans for counts
and economy, one for starts, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..schema import Corpus
from .asof import latest_when
from .ordered import first_n
from .scope import K

ORDINALS = ("first", "second", "third", "fourth", "fifth")
EARLY, MID, LATE, BUILT = range(1, 11), range(3, 13), range(5, 15), range(3, 11)

# The feature vocabulary per race. Each line of `units` is a minute
# range followed by names; `first` only need a first start; `up_to` gives the
# highest ordinal; upgrades have three levels.
SPEC = {
    "zerg": {
        "first": "overlord zergling hydralisk mutalisk lurker scourge queen ultralisk defiler guardian devourer",
        "counts": [(EARLY, "overlord zergling hydralisk"), (MID, "lurker mutalisk scourge queen"),
                   (LATE, "ultralisk defiler guardian devourer")],
        "buildings": [(1, "spawning_pool hydralisk_den evolution_chamber"), (5, "creep_colony sunken_colony spore_colony"),
                      (1, "spire queens_nest ultralisk_cavern defiler_mound"), (5, "nydus_canal")],
        "base": "hatchery",
        "upgrades": {"evolution_chamber": "zerg_melee_attacks zerg_missile_attacks zerg_carapace",
                     "spire": "flyer_attack flyer_carapace"},
        "research": {"spawning_pool": "metabolic_boost",
                     "hydralisk_den": "muscular_augments spined_grooves lurker_aspect",
                     "hatchery": "burrow lair",
                     "lair": "ventral_sacs antennae pneumatized_carapace hive",
                     "spire": "greater_spire",
                     "queens_nest": "ensnare spawn_broodling gamete_meiosis",
                     "defiler_mound": "consume plague metasynaptic_node",
                     "ultralisk_cavern": "anabolic_synthesis chitinous_plating"},
        "production": [],
    },
    "protoss": {
        "first": "zealot dragoon high_templar dark_templar observer reaver corsair scout carrier arbiter archon dark_archon shuttle",
        "counts": [(EARLY, "zealot dragoon"), (MID, "high_templar dark_templar observer archon dark_archon corsair scout"),
                   (LATE, "carrier arbiter shuttle reaver")],
        "buildings": [(5, "gateway"), (2, "forge"), (5, "cannon stargate robotics_facility"),
                      (1, "cybernetics_core citadel_of_adun templar_archives robotics_support_bay observatory fleet_beacon shield_battery")],
        "base": "nexus",
        "upgrades": {"forge": "ground_weapons ground_armor shields", "cybernetics_core": "air_weapons air_armor"},
        "research": {"cybernetics_core": "singularity_charge",
                     "observatory": "sensor_array gravitic_booster",
                     "robotics_support_bay": "scarab_damage increased_reaver_capacity gravitic_drive",
                     "templar_archives": "psionic_storm hallucination khaydarin_amulet maelstrom mind_control argus_talisman",
                     "fleet_beacon": "carrier_capacity apial_sensors gravitic_thrusters disruption_web argus_jewel"},
        "production": [(EARLY, "gateway"), (BUILT, "stargate robotics_facility")],
    },
    "terran": {
        "first": "marine medic firebat ghost vulture siege_tank goliath wraith valkyrie dropship battlecruiser science_vessel",
        "counts": [(EARLY, "marine medic firebat"), (LATE, "ghost"), (MID, "vulture siege_tank goliath"),
                   (LATE, "wraith dropship valkyrie science_vessel battlecruiser")],
        "buildings": [(5, "barracks factory machine_shop starport control_tower"), (2, "engineering_bay"), (4, "armory"),
                      (1, "science_facility covert_ops physics_lab"), (5, "comsat_station"), (1, "nuclear_silo academy")],
        "base": "command_center",
        "upgrades": {"engineering_bay": "infantry_weapons infantry_armor",
                     "armory": "vehicle_weapons vehicle_plating ship_weapons ship_plating"},
        "research": {"academy": "stim_pack u_238_shells restoration optical_flare caduceus_reactor",
                     "machine_shop": "siege_tech spider_mines ion_thrusters charon_boosters",
                     "control_tower": "cloaking_field apollo_reactor",
                     "covert_ops": "personnel_cloaking lockdown ocular_implants moebius_reactor",
                     "physics_lab": "yamato_gun colossus_reactor",
                     "science_facility": "emp_shockwave irradiate titan_reactor"},
        "production": [(EARLY, "barracks"), (BUILT, "factory machine_shop starport")],
    },
}

# Recorded names that differ from the name used in a feature.
START_ALIASES = {
    "cannon": "photon_cannon", "spined_grooves": "grooved_spines", "burrow": "burrowing",
    "spawn_broodling": "spawn_broodlings", "zerg_carapace": "carapace", "flyer_attack": "zerg_flyer_attacks",
    "ground_weapons": "protoss_ground_weapons", "ground_armor": "protoss_armor", "shields": "plasma_shields",
    "air_weapons": "protoss_air_weapons", "air_armor": "protoss_plating", "gravitic_booster": "gravitic_boosters",
    "increased_reaver_capacity": "reaver_capacity", "stim_pack": "stim_packs", "siege_tech": "siege_mode",
}
TOWN_HALLS = ("hatchery", "lair", "hive", "nexus", "command_center")
GLOBAL_SAMPLED = ("worker_count", "army_supply", "town_hall_count", "minerals_gathered_cumulative", "gas_gathered_cumulative")


def _recorded(name: str) -> str:
    return START_ALIASES.get(name, name)


def count_features(race: str) -> list[tuple[str, str, int]]:
    """(column, unit, minute) for every unit or building count."""
    spec = SPEC[race]
    return [
        (f"{u}_count_at_{m}m", u, m)
        for minutes, names in (*spec["counts"], *spec["production"])
        for u in names.split()
        for m in minutes
    ]


def start_features(race: str) -> list[tuple[str, str, int]]:
    """(column, item, n) for every n-th start of an item."""
    spec = SPEC[race]
    out = [(f"time_first_started_{u}_s", _recorded(u), 1) for u in spec["first"].split()]
    for top, names in spec["buildings"]:
        out += [(f"time_{ORDINALS[k]}_started_{b}_s", _recorded(b), k + 1) for b in names.split() for k in range(top)]
    out += [(f"time_{ORDINALS[k]}_started_{spec['base']}_s", spec["base"], k + 1) for k in range(1, 5)]
    for home, names in spec["upgrades"].items():
        out += [
            (f"time_upgrade_started_{home}_{u}_{level}_s", _recorded(u), level) for u in names.split() for level in (1, 2, 3)
        ]
    for home, names in spec["research"].items():
        out += [(f"time_research_started_{home}_{r}_s", _recorded(r), 1) for r in names.split()]
    return out


def global_features() -> list[str]:
    return ["opponent_race", "map_name", "spawn_position_relation"] + [
        f"{g}_at_{m}m" for g in GLOBAL_SAMPLED for m in EARLY
    ]


def feature_names(race: str) -> list[str]:
    return [c for c, _, _ in count_features(race)] + [c for c, _, _ in start_features(race)]


def counts_at_minutes(counts: DataFrame, wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Long (participant, feature, value): latest counts at or before each minute.

    One aggregate per (participant, unit) with a column per minute.
    """
    minutes = sorted({m for _, _, m in wanted})
    units = sorted({u for _, u, _ in wanted})
    key = normalize_key("unit_type")
    rows = counts.where(F.col("time_seconds") <= 60 * minutes[-1]).withColumn("_u", key).where(F.col("_u").isin(*units))
    order = ["time_seconds", "frame"]
    agg = rows.groupBy(*K, "_u").agg(
        *[latest_when(F.col("time_seconds") <= 60 * m, ["count"], order).alias(f"m{m}") for m in minutes]
    )
    entries = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"m{m}")["count"].cast("double").alias("v")) for m in minutes])
    long = agg.select(*K, "_u", F.explode(entries).alias("e")).where(F.col("e")["v"].isNotNull())
    return long.select(
        *K, F.concat(F.col("_u"), F.lit("_count_at_"), F.col("e")["m"].cast("string"), F.lit("m")).alias("feature"), F.col("e")["v"].alias("value")
    )


def starts_of(events: DataFrame, wanted: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Long (participant, item, n, value) of the first few starts per item."""
    items = sorted({i for _, i, _ in wanted})
    rows = events.select(*K, normalize_key("item").alias("_i"), "time_seconds", "event_seq").where(F.col("_i").isin(*items))
    top = first_n(rows, [*K, "_i"], ["time_seconds", "event_seq"], max(n for _, _, n in wanted))
    return top.select(*K, F.concat_ws("#", F.col("_i"), F.col("n").cast("string")).alias("feature"), F.col("time_seconds").cast("double").alias("value"))


def _gather(long: DataFrame, name: str) -> DataFrame:
    """One map per participant; as many entries as there are features at most."""
    return long.groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias(name))


def feature_matrix(corpus: Corpus, race: str, *, extra_counts: Sequence[tuple[str, str, int]] = (), extra_starts: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """Participants of one race with the global and race-specific columns.

    Values that do not exist are null. `map_name` comes from the match;
    `spawn_position_relation` has no source and is null. Army supply is supply
    in use less workers.
    """
    race = race.lower()
    counts_wanted = [*count_features(race), *extra_counts]
    starts_wanted = [*start_features(race), *extra_starts]
    people = corpus.players.where(F.col("race_lc") == race).select(*K, "name", "race")
    mine = lambda df: df.join(people.select(*K), K, "left_semi")

    counted = _gather(counts_at_minutes(mine(corpus.unit_count_samples), counts_wanted), "_counts")
    started = _gather(starts_of(mine(corpus.build_order_events), starts_wanted), "_starts")
    t, order = F.col("time_seconds"), ["time_seconds", "frame"]
    limit = 60 * max(EARLY)
    eco = mine(corpus.economy_samples).where(t <= limit).groupBy(*K).agg(
        *[latest_when(t <= 60 * m, ["workers", "gathered_minerals", "gathered_gas"], order).alias(f"_e{m}") for m in EARLY]
    )
    sup = mine(corpus.supply_samples).where(t <= limit).groupBy(*K).agg(
        *[latest_when(t <= 60 * m, ["current"], order).alias(f"_s{m}") for m in EARLY]
    )
    halls_rows = mine(corpus.unit_count_samples).withColumn("_u", normalize_key("unit_type")).where(
        F.col("_u").isin(*TOWN_HALLS) & (t <= limit)
    )
    per_hall = halls_rows.groupBy(*K, "_u").agg(
        *[latest_when(t <= 60 * m, ["count"], order).alias(f"_h{m}") for m in EARLY]
    )
    halls = per_hall.groupBy(*K).agg(*[F.sum(F.col(f"_h{m}")["count"]).alias(f"_h{m}") for m in EARLY])
    wide = people
    for df in (counted, started, eco, sup, halls):
        wide = wide.join(df, K, "left")
    # Opponent race: of the only other participant.
    duel = corpus.players.groupBy("replay_id").agg(F.count(F.lit(1)).alias("_n"), F.min("owner").alias("_a"), F.max("owner").alias("_b"),
                                                   F.min_by("race", "owner").alias("_ra"), F.max_by("race", "owner").alias("_rb"))
    wide = wide.join(duel, "replay_id").join(corpus.replays.select("replay_id", F.col("map").alias("map_name")), "replay_id", "left")
    cols = [
        F.when(F.col("_n") == 2, F.when(F.col("owner") == F.col("_a"), F.col("_rb")).otherwise(F.col("_ra"))).alias("opponent_race"),
        F.col("map_name"),
        F.lit(None).cast("string").alias("spawn_position_relation"),
    ]
    per_minute = {
        "worker_count": lambda m: F.col(f"_e{m}")["workers"].cast("double"),
        "army_supply": lambda m: (F.col(f"_s{m}")["current"] - F.col(f"_e{m}")["workers"]).cast("double"),
        "town_hall_count": lambda m: F.col(f"_h{m}").cast("double"),
        "minerals_gathered_cumulative": lambda m: F.col(f"_e{m}")["gathered_minerals"].cast("double"),
        "gas_gathered_cumulative": lambda m: F.col(f"_e{m}")["gathered_gas"].cast("double"),
    }
    cols += [per_minute[g](m).alias(f"{g}_at_{m}m") for g in GLOBAL_SAMPLED for m in EARLY]
    cols += [F.col("_counts")[f"{u}_count_at_{m}m"].alias(c) for c, u, m in counts_wanted]
    cols += [F.col("_starts")[f"{i}#{n}"].alias(c) for c, i, n in starts_wanted]
    return wide.select(*K, "name", "race", *cols)
