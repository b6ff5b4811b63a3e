"""Questions about sampled series: composition, economy and full state at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower_text, normalize_key, titleize
from .asof import asof_const, latest_when
from .quantiles import summarize
from .scope import K, selfs

ECONOMY = ["minerals", "gas", "gathered_minerals", "gathered_gas", "workers"]

# Checkpoint times in seconds.
CHECKPOINTS = (180, 240, 300, 360, 420, 480, 600, 720)


def unit_count_at(counts: DataFrame, targets: DataFrame, unit: str, at: float) -> DataFrame:
    """Each target with its latest count of a unit at or before `at`."""
    rows = counts.where(F.col("unit_type_lc") == ascii_lower_text(unit))
    found = asof_const(rows, K, at, ["unit_type", "count"], tie=["frame"])
    return targets.join(found, K, "left")


def economy_at(economy: DataFrame, targets: DataFrame, at: float) -> DataFrame:
    """Each target with its latest economy sample at or before `at`."""
    return targets.join(asof_const(economy, K, at, ECONOMY, tie=["frame"]), K, "left")


def default_units(counts: DataFrame, parts: DataFrame, at: float, top: int = 8) -> DataFrame:
    """The most sampled unit types up to `at`, folded by case."""
    rows = counts.where(F.col("time_seconds") <= at).select(*K, "unit_type", "unit_type_lc")
    weighted = rows.join(selfs(parts).select(*K), K, "left_semi")
    return (
        weighted.groupBy("unit_type_lc")
        .agg(F.min("unit_type").alias("unit_type"), F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.col("row_count").desc(), "unit_type_lc")
        .limit(top)
    )


def composition_counts(
    counts: DataFrame, parts: DataFrame, at: float, units: Sequence[str] | None = None, top: int = 8
) -> DataFrame:
    """Latest count per self participant and unit; absent units stay absent."""
    rows = counts.where(F.col("time_seconds") <= at)
    if units:
        named = [u.strip() for u in units if u.strip()]
        rows = rows.where(F.col("unit_type_lc").isin(*[ascii_lower_text(u) for u in named]))
        label = F.lit(None).cast("string")
        for u in named:
            label = F.when(F.col("unit_type_lc") == ascii_lower_text(u), F.lit(u)).otherwise(label)
        rows = rows.withColumn("unit", label)
    else:
        chosen = default_units(counts, parts, at, top).select("unit_type_lc", F.col("unit_type").alias("unit"))
        # At most `top` rows.
        rows = rows.join(F.broadcast(chosen), "unit_type_lc")
    latest = asof_const(rows, [*K, "unit"], at, ["count"], tie=["frame"])
    return selfs(parts).join(latest, K).withColumn("count", F.col("sample")["count"])


def composition_snapshot(
    counts: DataFrame,
    parts: DataFrame,
    at: float,
    units: Sequence[str] | None = None,
    top: int = 8,
    *,
    distributed: bool | None = None,
) -> DataFrame:
    """Per unit the distribution of counts at `at` over participants that have one."""
    rows = composition_counts(counts, parts, at, units, top)
    return summarize(rows, "count", ["unit"], "as_self", distributed=distributed)


def composition_sample_size(rows: DataFrame) -> DataFrame:
    """Scope rows with at least one of the units."""
    per_key = rows.groupBy(*K).agg(F.max("as_self").alias("w"))
    return per_key.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("sample_size"))


def economy_distribution(
    economy: DataFrame, parts: DataFrame, at: float, *, distributed: bool | None = None
) -> DataFrame:
    """Distribution of workers, minerals and gas at `at`, one row per measure.

    `sample_size` counts scope rows with any sample; a sample without workers
    adds to minerals and gas only.
    """
    latest = asof_const(economy, K, at, ["workers", "minerals", "gas"], tie=["frame"])
    rows = selfs(parts).join(latest, K)
    s = F.col("sample")
    long = rows.select(
        "as_self",
        F.explode(
            F.create_map(
                F.lit("workers"), s["workers"].cast("double"),
                F.lit("minerals"), s["minerals"].cast("double"),
                F.lit("gas"), s["gas"].cast("double"),
            )
        ).alias("measure", "value"),
    )
    return summarize(long, "value", ["measure"], "as_self", distributed=distributed)


def state_at(economy: DataFrame, supply: DataFrame, counts: DataFrame, at: float) -> DataFrame:
    """Economy, supply and unit counts in force at `at` for every participant.

    Before the first sample the first one counts. Counts come as one map: the
    sample nearest in time is picked per participant, then its units.
    """
    def stepped(df: DataFrame, payload: Sequence[str], name: str) -> DataFrame:
        t = F.col("time_seconds")
        order = ["time_seconds", "frame"]
        return df.groupBy(*K).agg(
            F.coalesce(
                latest_when(t <= at, payload, order),
                F.min_by(F.struct(*payload), F.struct(*order)),
            ).alias(name)
        )

    eco, sup = stepped(economy, ECONOMY, "e"), stepped(supply, ["current", "max"], "s")
    t = F.col("time_seconds")
    # One row per sample time first; the units of the chosen sample are a
    # vocabulary of the game, so the map is bounded.
    at_time = counts.groupBy(*K).agg(
        F.coalesce(F.max(F.when(t <= at, t)), F.min(t)).alias("_at")
    )
    army = (
        counts.join(at_time, K)
        .where((t == F.col("_at")) & (F.col("count") > 0))
        .groupBy(*K, "unit_type")
        .agg(F.max_by("count", "frame").alias("count"))
        .groupBy(*K)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit_type", "count")))).alias("counts"))
    )
    e = F.col("e")
    return (
        eco.join(sup, K, "full_outer")
        .join(army, K, "full_outer")
        .select(
            *K,
            *[F.coalesce(e[c], F.lit(0)).alias(c) for c in ECONOMY],
            F.coalesce(F.col("s")["current"], F.lit(0)).alias("supply_current"),
            F.coalesce(F.col("s")["max"], F.lit(0)).alias("supply_max"),
            "counts",
        )
    )


# Unit groups that set the order of a composition listing.
EXCLUDED = ("larva", "egg")
WORKERS = ("scv", "probe", "drone")
BASIC_ARMY = ("marine", "firebat", "vulture", "zealot", "dragoon", "zergling", "hydralisk")
SPECIAL_UNITS = """
ghost medic science_vessel dropship observer shuttle
high_templar dark_templar archon dark_archon reaver arbiter
queen defiler lurker
""".split()
SUPPLY_UNITS = ("overlord", "pylon", "supply_depot")
STATIC_DEFENSE = """
bunker missile_turret photon_cannon shield_battery
sunken_colony spore_colony creep_colony
""".split()
PRODUCTION = """
barracks factory starport gateway robotics_facility stargate
spawning_pool hydralisk_den spire greater_spire
""".split()
TECH_BUILDINGS = """
refinery engineering_bay academy science_facility armory
machine_shop control_tower physics_lab covert_ops
assimilator forge cybernetics_core citadel_of_adun robotics_support_bay
fleet_beacon templar_archives observatory arbiter_tribunal
extractor evolution_chamber queens_nest ultralisk_cavern
defiler_mound nydus_canal
""".split()
TOWN_HALLS = ("command_center", "nexus", "hatchery", "lair", "hive")


def composition_rank(key: Column, catalog_type: Column) -> Column:
    """1-10: workers, basic army, other units, specials, supply, defence, production,
    tech, town halls, rest."""
    plain_unit = (catalog_type == "Unit") & ~key.isin(*SPECIAL_UNITS) & ~key.isin(*SUPPLY_UNITS)
    return (
        F.when(key.isin(*WORKERS), 1)
        .when(key.isin(*BASIC_ARMY), 2)
        .when(plain_unit, 3)
        .when(key.isin(*SPECIAL_UNITS), 4)
        .when(key.isin(*SUPPLY_UNITS), 5)
        .when(key.isin(*STATIC_DEFENSE), 6)
        .when(key.isin(*PRODUCTION), 7)
        .when(key.isin(*TOWN_HALLS), 9)
        .when(key.isin(*TECH_BUILDINGS) | catalog_type.isin("Building", "Addon"), 8)
        .otherwise(10)
    )


def catalog_by_key(catalog: DataFrame) -> DataFrame:
    """One catalog row per normalised name, with its position in the catalog."""
    index = F.col("catalog_index") if "catalog_index" in catalog.columns else F.lit(0)
    return catalog.groupBy(normalize_key("name").alias("unit_key")).agg(
        F.max_by(
            F.struct(
                F.col("name"), F.col("type"), F.coalesce("mineralCost", F.lit(0)).alias("mineralCost"),
                F.coalesce("gasCost", F.lit(0)).alias("gasCost"), index.alias("catalog_index"),
            ),
            F.struct(index, "name"),
        ).alias("_cat")
    )


def checkpoint_composition(
    counts: DataFrame,
    catalog: DataFrame | None = None,
    times: Sequence[int] = CHECKPOINTS,
    *,
    max_rows: int | None = None,
) -> DataFrame:
    """Unit counts in force at each checkpoint not after the last sample.

    A checkpoint before the first sample has no rows. The sample is picked by
    time and all its units listed, so a unit missing from it is gone.
    """
    stamps = counts.groupBy(*K, "time_seconds").agg(F.lit(1).alias("one"))
    aggs = [F.max(F.when(F.col("time_seconds") <= c, F.col("time_seconds"))).alias(f"_{c}") for c in times]
    at = stamps.groupBy(*K).agg(F.max("time_seconds").alias("_last"), *aggs)
    wanted = at.select(
        *K,
        "_last",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.col(f"_{c}").alias("time_seconds")) for c in times])
        ).alias("w"),
    ).where((F.col("w")["checkpoint"] <= F.col("_last")) & F.col("w")["time_seconds"].isNotNull())
    wanted = wanted.select(*K, F.col("w")["checkpoint"].alias("checkpoint"), F.col("w")["time_seconds"].alias("time_seconds"))
    key = normalize_key("unit_type")
    rows = counts.join(wanted, [*K, "time_seconds"]).where((F.col("count") > 0) & ~key.isin(*EXCLUDED))
    rows = rows.withColumn("unit_key", key)
    if catalog is not None:
        rows = rows.join(catalog_by_key(catalog), "unit_key", "left")
    else:
        rows = rows.withColumn("_cat", F.lit(None).cast("struct<name:string,type:string,catalog_index:int>"))
    cat = F.col("_cat")
    return rows.select(
        *K,
        "checkpoint",
        "unit_key",
        F.coalesce(cat["name"], titleize("unit_key")).alias("display_name"),
        "count",
        composition_rank(F.col("unit_key"), cat["type"]).alias("category_rank"),
        F.coalesce(cat["catalog_index"], F.lit(2**31 - 1)).alias("catalog_index"),
    )


