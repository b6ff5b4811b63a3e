"""Name dimensions for upgrade and research ids; unit names come as a table.

Unit names are a parameter: pass a two-column DataFrame (id, name), or let
`observed_unit_names` read them off the timeline, where each unit carries both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_type

# Upgrade names, in id order from 0.
UPGRADE_NAMES = """
infantry_armor vehicle_plating ship_plating carapace flyer_carapace
protoss_armor protoss_plating infantry_weapons vehicle_weapons ship_weapons
zerg_melee_attacks zerg_missile_attacks zerg_flyer_attacks protoss_ground_weapons protoss_air_weapons
plasma_shields u_238_shells ion_thrusters burst_lasers titan_reactor
ocular_implants moebius_reactor apollo_reactor colossus_reactor ventral_sacs
antennae pneumatized_carapace metabolic_boost adrenal_glands muscular_augments
grooved_spines gamete_meiosis metasynaptic_node singularity_charge leg_enhancements
scarab_damage reaver_capacity gravitic_drive sensor_array gravitic_boosters
khaydarin_amulet apial_sensors gravitic_thrusters carrier_capacity khaydarin_core
upgrade_45 upgrade_46 argus_jewel upgrade_48 argus_talisman
upgrade_50 caduceus_reactor chitinous_plating anabolic_synthesis charon_boosters
""".split()

# Research names, in id order from 0.
TECH_NAMES = """
stim_packs lockdown emp_shockwave spider_mines scanner_sweep
siege_mode defensive_matrix irradiate yamato_gun cloaking_field
personnel_cloaking burrowing infestation spawn_broodlings dark_swarm
plague consume ensnare parasite psionic_storm
hallucination recall stasis_field archon_warp restoration
disruption_web tech_26 mind_control dark_archon_meld feedback
optical_flare maelstrom lurker_aspect tech_33 healing
""".split()


def _lookup(names: list[str], ident: Column, prefix: str) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    inside = (ident >= 0) & (ident < len(names))
    return F.when(inside, F.get(table, ident.cast("int"))).otherwise(F.concat(F.lit(prefix), ident.cast("string")))


def upgrade_name(ident: Column | str) -> Column:
    return _lookup(UPGRADE_NAMES, F.col(ident) if isinstance(ident, str) else ident, "upgrade_")


def tech_name(ident: Column | str) -> Column:
    return _lookup(TECH_NAMES, F.col(ident) if isinstance(ident, str) else ident, "tech_")


def observed_unit_names(units: DataFrame) -> DataFrame:
    """(type_id, type_name) pairs seen in the units of a timeline.

    Partial aggregation leaves one row per id and map task, and the result has
    as many rows as there are unit ids, a fixed vocabulary of the game.
    """
    return (
        units.where(F.col("unit_type").isNotNull() & F.col("unit_type_id").isNotNull())
        .groupBy(F.col("unit_type_id").alias("type_id"))
        .agg(F.min(normalize_type("unit_type")).alias("type_name"))
    )
