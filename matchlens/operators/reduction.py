"""Raw per-frame timelines reduced to typed series, as set operations.

A snapshot has owners with scalars, unit counts and units, and a list of
deaths. `explode_timeline` flattens that; every output is a query over the flat
rows. State the game keeps per unit becomes a comparison with the unit's row
before; state kept per snapshot becomes a comparison of snapshot ordinals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import observed_unit_names, tech_name, upgrade_name
from ..functions.text import (
    IGNORED_CATEGORIES,
    TRANSIENT_TYPES,
    display_name,
    frame_seconds,
    is_building_id,
    is_omitted_type,
    matchup_text,
    normalize_type,
    unit_race,
)
from ..sources.staging import stage
from .changes import compact_changes, frame_gaps, map_value
from .ordered import SLICE, is_small, ordered_scan

M, KU = "replay_id", ["replay_id", "owner", "unit_id"]
K = [M, "owner"]
# Number of unit ids the game knows; ids beyond it have no name.
UNIT_IDS = 228
# Snapshots from sources up to this size are read again rather than written.
SMALL_TIMELINE_BYTES = 4 * 1024 * 1024
UNIT_FIELDS = """
unit_type unit_type_id category build_queue_unit_ids upgrade_in_progress tech_in_progress
morphing_building morph_target_unit_type_id build_time remaining_build_time
""".split()


def written(raw: DataFrame) -> DataFrame:
    """The snapshots as a scan: what is derived or large is written once, since every series reads it."""
    plan = raw._jdf.queryExecution().optimizedPlan()
    return raw if plan.children().isEmpty() or is_small(raw, SMALL_TIMELINE_BYTES) else stage(raw, "snapshots")


class Timeline:
    """Flat rows of a set of timelines; `owners` keeps these alone.

    Snapshots are written when their units or their numbers are asked for, which
    takes several readings. Scalars and deaths by themselves read only their own
    columns of what was given.
    """

    def __init__(self, raw: DataFrame, owners: Sequence[int] | None = None, max_rows: int | None = None):
        self._raw, self._owners, self._max_rows = raw, owners, max_rows

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows if self._owners is None else rows.where(F.col("owner").isin(*self._owners))

    @cached_property
    def _written(self) -> DataFrame:
        return written(self._raw)

    def _flat(self, explode: Callable = F.explode) -> DataFrame:
        return self.__dict__.get("_written", self._raw).select(M, "frame", explode("owners").alias("_k", "o")).select(
            M, "frame", F.col("_k").cast("int").alias("owner"), "o.*"
        )

    def _numbered(self, fields: Sequence[str]) -> DataFrame:
        """replay_id, frame, owner, ordinal, unit_id and the fields of units, and the slice of a hot match; snapshots without units count too"""
        rows = self._flat(F.explode_outer).select(M, "frame", "owner", F.explode_outer("units").alias("u")).select(
            M, "frame", "owner", F.col("u").isNotNull().alias("_unit"), F.col("u.id").alias("unit_id"), *[F.col(f"u.{f}") for f in fields])
        # A row opens a snapshot when the row before is of another frame; both scans go over the rows as they lie.
        stepped = ordered_scan(rows, [M], ["frame"], {"_before": ("previous", F.struct("frame"))}, max_rows=self._max_rows, keep_slice=True)
        opens = F.when(F.col("_before").isNull() | ~F.col("_before.frame").eqNullSafe(F.col("frame")), 1).otherwise(0)
        placed = ordered_scan(stepped, [M], ["frame"], {"ordinal": ("total", opens.cast("bigint"))}, max_rows=self._max_rows, keep_slice=True)
        kept = placed.where(F.col("_unit") & F.col(M).isNotNull() & F.col("frame").isNotNull())
        return self._kept(kept.drop("_unit", "_before"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """replay_id, frame, ordinal"""
        return ordered_scan(
            self._written.select(M, "frame").distinct(), [M], ["frame"], {"ordinal": ("total", F.lit(1).cast("bigint"))}, max_rows=self._max_rows
        )

    @property
    def owners(self) -> DataFrame:
        """replay_id, frame, owner, scalars, unit_counts"""
        return self._kept(self._flat().drop("units"))

    @property
    def unit_rows(self) -> DataFrame:
        """replay_id, frame, owner, unit columns; without the number of the snapshot nothing is written or joined"""
        # Only the fields the reduction uses; packed timelines carry more, among them another owner.
        return self._kept(self._flat().select(M, "frame", "owner", F.explode("units").alias("u")).select(
            M, "frame", "owner", F.col("u.id").alias("unit_id"), *[F.col(f"u.{f}") for f in UNIT_FIELDS]
        ))

    @cached_property
    def units(self) -> DataFrame:
        """replay_id, frame, owner, ordinal, unit columns, and the slice of a hot match, which serves scans by unit too"""
        _ = self._written
        return self._numbered(UNIT_FIELDS)

    @property
    def researching(self) -> DataFrame:
        """replay_id, frame, owner, ordinal, what a unit researches; for one reading, so that nothing wide is written"""
        return self._numbered(["upgrade_in_progress", "tech_in_progress"])

    @property
    def deaths(self) -> DataFrame:
        """replay_id, frame, owner, unit_type, ..."""
        raw = self.__dict__.get("_written", self._raw)
        return self._kept(raw.select(M, "frame", F.explode("deaths").alias("d")).select(M, "frame", "d.*"))


def explode_timeline(raw: DataFrame, *, max_rows: int | None = None) -> Timeline:
    """Flatten snapshots (replay_id, frame, owners, deaths); number them per match.

    Units are numbered where they lie by match, and later scans by unit, by owner
    and by what is researched go on there without another shuffle.
    """
    return Timeline(raw, max_rows=max_rows)


def economy_series(owners: DataFrame) -> DataFrame:
    """Samples of owners that report both minerals and gas."""
    return owners.where(F.col("minerals").isNotNull() & F.col("gas").isNotNull()).select(
        *K, "frame", frame_seconds("frame").alias("time_seconds"), "minerals", "gas", "gathered_minerals", "gathered_gas",
        F.col("workers_alive").alias("workers"),
    )


def supply_series(owners: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """Supply samples, only where current or maximum changed."""
    rows = owners.where(F.col("supply_current").isNotNull() & F.col("supply_max").isNotNull()).select(
        *K, "frame", frame_seconds("frame").alias("time_seconds"), F.col("supply_current").alias("current"), F.col("supply_max").alias("max")
    )
    return compact_changes(rows, K, ["frame"], F.struct("current", "max"), max_rows=max_rows)


def clean_counts(counts: Column) -> Column:
    """Normalised names, omitted types dropped, the last of equal names kept."""
    entries = F.filter(F.map_entries(counts), lambda e: ~is_omitted_type(normalize_type(e["key"])))
    named = F.transform(entries, lambda e: F.struct(normalize_type(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        named,
        lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda x: x["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def count_series(owners: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """Unit count maps, only where the map changed."""
    rows = owners.where(F.col("unit_counts").isNotNull()).select(
        *K, "frame", frame_seconds("frame").alias("time_seconds"), clean_counts(F.col("unit_counts")).alias("counts")
    )
    return compact_changes(rows, K, ["frame"], map_value("counts"), max_rows=max_rows)


def death_series(deaths: DataFrame) -> DataFrame:
    """Deaths by losing owner, without omitted types."""
    return deaths.withColumn("unit_type", normalize_type("unit_type")).where(~is_omitted_type("unit_type")).select(
        *K, "frame", frame_seconds("frame").alias("time_seconds"), F.col("owner").alias("dead_owner"), "unit_type",
        "category", F.col("id").alias("unit_id"), "unit_type_id", "pos_x", "pos_y",
    )


def backdate(frame: Column, build_time: Column, remaining: Column) -> Column:
    """The frame a partly observed build began: earlier by what is already built."""
    elapsed = F.greatest(F.lit(0), F.least(build_time, build_time - remaining))
    usable = build_time.isNotNull() & remaining.isNotNull() & (build_time > 0) & (remaining >= 0)
    return F.when(usable, F.greatest(F.lit(0), frame - elapsed)).otherwise(frame)


def _named_units(units: DataFrame, names: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    table = names if names is not None else observed_unit_names(units)
    # At most UNIT_IDS rows: one per unit id of the game.
    known = table.where(F.col("type_id").between(0, UNIT_IDS - 1)).groupBy("type_id").agg(F.min("type_name").alias("type_name"))
    ready = units.withColumn("unit_type_id", F.coalesce("unit_type_id", F.lit(-1)))
    own = F.broadcast(known.select(F.col("type_id").alias("unit_type_id"), F.col("type_name").alias("_n")))
    ready = ready.join(own, "unit_type_id", "left").withColumn(
        "unit_type",
        normalize_type(F.coalesce("unit_type", "_n", F.concat(F.lit("unit_"), F.col("unit_type_id").cast("string")))),
    ).drop("_n")
    return ready, known


def _with_target_name(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Name of `target`; ids outside the game's range have none."""
    dim = F.broadcast(known.select(F.col("type_id").alias("target"), F.col("type_name").alias("_tn")))
    inside = F.col("target").between(0, UNIT_IDS - 1)
    return rows.join(dim, "target", "left").withColumn(
        "target_name",
        F.coalesce("target_name", F.when(inside, normalize_type(F.coalesce("_tn", F.concat(F.lit("unit_"), F.col("target").cast("string")))))),
    ).drop("_tn")


def unit_steps(units: DataFrame, *, include_initial: bool = False, max_rows: int | None = None) -> DataFrame:
    """Each unit row with the unit's type (`_prev_type`) and queue (`_prev`) one row before, from one scan.

    Queues of the very first snapshot are not remembered unless initial events
    are asked for, so what was queued there shows up one snapshot later.
    """
    queue = F.filter(F.coalesce("build_queue_unit_ids", F.array().cast("array<int>")), lambda x: x.isNotNull())
    remembered = F.when(F.lit(include_initial) | (F.col("ordinal") > 1), F.col("_q"))
    return ordered_scan(
        units.withColumn("_q", queue), KU, ["frame"],
        {"_prev_type": ("previous", F.col("unit_type_id")), "_prev": ("previous", remembered)}, max_rows=max_rows, keep_slice=True,
    )


def _stepped(units: DataFrame, include_initial: bool, max_rows: int | None) -> DataFrame:
    """Rows that may start something, with the row before."""
    steps = units if "_prev_type" in units.columns else unit_steps(units, include_initial=include_initial, max_rows=max_rows)
    return steps.where(F.lit(include_initial) | (F.col("ordinal") > 1))


def grown() -> Column:
    """Targets of a row's queue with the copies that the row before did not have."""
    prev = F.coalesce("_prev", F.array().cast("array<int>"))
    copies = lambda q, x: F.size(F.filter(q, lambda y: y == x))
    return F.filter(
        F.transform(
            F.array_distinct("_q"),
            lambda x: F.struct(x.alias("target"), (copies(F.col("_q"), x) - copies(prev, x)).alias("copies")),
        ),
        lambda s: s["copies"] > 0,
    )


def queue_increments(units: DataFrame, *, include_initial: bool = False, max_rows: int | None = None) -> DataFrame:
    """Per unit row, queue targets whose copies grew since the unit's row before.

    `units` may come with `unit_steps` done.
    """
    return _stepped(units, include_initial, max_rows).select(
        *KU, "frame", "ordinal", "morphing_building", "build_time", "remaining_build_time", F.posexplode(grown()).alias("pos", "g")
    ).select("*", "g.target", "g.copies").drop("g")


def _own_start() -> tuple[Column, Column]:
    """Whether a row morphs, and whether it is a new or changed building."""
    morph = F.col("morph_target_unit_type_id")
    fresh = F.col("_prev_type").isNull() | (F.col("_prev_type") != F.col("unit_type_id"))
    return morph.isNotNull() & morph.between(0, UNIT_IDS - 1), (F.col("category") == "building") & fresh


def building_candidates(units: DataFrame, known: DataFrame, *, include_initial: bool = False, max_rows: int | None = None) -> DataFrame:
    """Rows that may start a building: a morph target, or a new or changed building.

    `units` may come with `unit_steps` done.
    """
    morphs, built = _own_start()
    rows = _stepped(units, include_initial, max_rows).where(morphs | built).select(
        *KU, "frame", F.lit(-1).alias("pos"), "build_time", "remaining_build_time",
        F.when(morphs, F.col("morph_target_unit_type_id")).otherwise(F.col("unit_type_id")).alias("target"),
        F.when(~morphs, F.col("unit_type")).alias("target_name"),
    )
    return _with_target_name(rows, known)


def start_candidates(
    units: DataFrame, known: DataFrame, *, include_initial: bool = False, structure: Callable[[Column], Column] = is_building_id,
    max_rows: int | None = None,
) -> DataFrame:
    """`building_candidates` and the buildings that morphing units have queued, in one pass that keeps rows with their unit."""
    return _candidates(units, known, include_initial, structure, max_rows, F.lit(False), [])


def _candidates(
    units: DataFrame, known: DataFrame, include_initial: bool, structure: Callable[[Column], Column], max_rows: int | None, shown: Column, carried: Sequence[str],
) -> DataFrame:
    """Start candidates; a `shown` row that starts nothing itself comes without a target."""
    morphs, built = _own_start()
    queued = F.filter(
        F.transform(grown(), lambda g, i: F.struct(i.alias("pos"), g["target"].alias("target"), F.lit(None).cast("string").alias("target_name"))),
        lambda g: structure(g["target"]) & F.coalesce("morphing_building", F.lit(False)))
    own = F.struct(
        F.lit(-1).alias("pos"), F.when(morphs, F.col("morph_target_unit_type_id")).otherwise(F.col("unit_type_id")).alias("target"),
        F.when(~morphs, F.col("unit_type")).alias("target_name"))
    idle = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("target"), F.lit(None).cast("string").alias("target_name"))
    both = F.when(morphs | built, F.concat(F.array(own), queued)).when(shown, F.concat(F.array(idle), queued)).otherwise(queued)
    rows = _stepped(units, include_initial, max_rows).select(
        *KU, SLICE, "frame", "build_time", "remaining_build_time", *carried, F.coalesce(shown, F.lit(False)).alias("_shown"), F.inline(both))
    return _with_target_name(rows, known).drop(*([] if carried else ["_shown"]))


def _usable_target() -> Column:
    return F.col("target_name").isNotNull() & ~F.col("target_name").isin(*TRANSIENT_TYPES)


def building_starts(candidates: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """Starts per unit: a candidate counts when its target differs from the one before.

    Short-lived types are dropped first. Within a frame the unit's own type
    comes before its queue.
    """
    rows = candidates.where(_usable_target())
    seen = ordered_scan(rows, KU, ["frame", "pos"], {"_last": ("previous", F.col("target"))}, max_rows=max_rows)
    kept = seen.where(~F.col("_last").eqNullSafe(F.col("target")))
    return kept.select(
        *KU,
        backdate(F.col("frame"), F.col("build_time"), F.col("remaining_build_time")).alias("frame"),
        F.col("frame").alias("seen_frame"),
        "pos",
        "target",
        "target_name",
    )


def research_starts(units: DataFrame, *, include_initial: bool = False, include_tech: bool = False, max_rows: int | None = None) -> DataFrame:
    """Upgrades and research in progress now but not in the snapshot just before.

    Being absent from a snapshot, or the owner being absent, ends the run, so a
    gap in the snapshot ordinals is exactly a new start.
    """
    kinds = [F.struct(F.lit("upgrade").alias("kind"), F.col("upgrade_in_progress").alias("ident"))]
    if include_tech:
        kinds.append(F.struct(F.lit("tech").alias("kind"), F.col("tech_in_progress").alias("ident")))
    # Slices cut between frames, so equal rows lie in one.
    at = [*K, "frame", "ordinal", *[SLICE] * (SLICE in units.columns)]
    rows = (
        units.select(*at, F.explode(F.filter(F.array(*kinds), lambda k: k["ident"].isNotNull())).alias("r"))
        .select(*at, "r.kind", "r.ident")
        .distinct()
    )
    seen = ordered_scan(
        rows, [*K, "kind", "ident"], ["ordinal"], {"_last": ("previous", F.col("ordinal"))}, max_rows=max_rows
    )
    new = (F.col("_last").isNull() | (F.col("_last") < F.col("ordinal") - 1)) & (
        F.lit(include_initial) | (F.col("ordinal") > 1)
    )
    return seen.where(new).select(
        *K, "frame", "kind", "ident",
        F.when(F.col("kind") == "upgrade", upgrade_name("ident")).otherwise(tech_name("ident")).alias("name"),
    )


def appearances(
    units: DataFrame, known: DataFrame, *, include_initial: bool = False, structure: Callable[[Column], Column] = is_building_id,
    max_rows: int | None = None,
) -> DataFrame:
    """New or changed non-building units that did not start a building in that frame.

    `units` may come with `unit_steps` done. What a unit starts is decided as in
    `building_starts`, in the same scan, so that starts are not joined back.
    """
    fresh = F.col("_prev_type").isNull() | (F.col("_prev_type") != F.col("unit_type_id"))
    shown = (
        fresh
        & (F.col("category") != "building")
        & ~F.col("category").isin(*IGNORED_CATEGORIES)
        & ~F.col("unit_type").isin(*TRANSIENT_TYPES)
    )
    rows = _candidates(units, known, include_initial, structure, max_rows, shown, ["unit_type"])
    usable = _usable_target()
    seen = ordered_scan(
        rows, KU, ["frame", "pos"], {"_last": ("past", F.when(usable, F.col("target")))}, max_rows=max_rows)
    started = usable & ~F.col("_last").eqNullSafe(F.col("target"))
    return seen.where(F.col("_shown") & (F.col("pos") == -1) & ~started).select(*K, "frame", "unit_type")


def infer_race(units: DataFrame) -> DataFrame:
    """Most observed race per participant, alphabetical on a tie.

    Observations are first counted per (participant, type), a small vocabulary.
    """
    cells = units.groupBy(*K, "unit_type", "unit_type_id").agg(F.count(F.lit(1)).alias("c"))
    races = cells.select(*K, unit_race(normalize_type("unit_type"), F.col("unit_type_id")).alias("race"), "c").where(
        F.col("race").isNotNull()
    )
    totals = races.groupBy(*K, "race").agg(F.sum("c").alias("n"))
    return totals.groupBy(*K).agg(F.min_by("race", F.struct((-F.col("n")).alias("k"), "race")).alias("race"))


def owner_names(owners: DataFrame) -> DataFrame:
    return owners.where(F.coalesce(F.length("name"), F.lit(0)) > 0).groupBy(*K).agg(F.min_by("name", "frame").alias("name"))


def build_events(
    units: DataFrame,
    names: DataFrame | None = None,
    *,
    include_initial: bool = False,
    include_tech: bool = False,
    include_unit_appearances: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """All start events (replay_id, owner, frame, name), equal lines collapsed."""
    units, known = _named_units(units, names)
    units = unit_steps(units, include_initial=include_initial, max_rows=max_rows)
    queued = queue_increments(units, include_initial=include_initial)
    queued = _with_target_name(queued.withColumn("target_name", F.lit(None).cast("string")), known).where(
        F.col("target_name").isNotNull() & ~F.col("target_name").isin(*TRANSIENT_TYPES)
    )
    trained = queued.where(~is_building_id("target")).select(*K, "frame", "target_name")
    candidates = start_candidates(units, known, include_initial=include_initial)
    started = building_starts(candidates, max_rows=max_rows)
    research = research_starts(units, include_initial=include_initial, include_tech=include_tech, max_rows=max_rows)
    out = (
        trained.withColumnRenamed("target_name", "raw")
        .unionByName(started.select(*K, "frame", F.col("target_name").alias("raw")))
        .unionByName(research.select(*K, "frame", F.col("name").alias("raw")))
    )
    if include_unit_appearances:
        seen = appearances(units, known, include_initial=include_initial, max_rows=max_rows)
        out = out.unionByName(seen.select(*K, "frame", F.col("unit_type").alias("raw")))
    return out.select(*K, "frame", display_name("raw").alias("item")).distinct().withColumn(
        "time_seconds", F.floor(frame_seconds("frame")).cast("double")
    )


def in_event_order(events: DataFrame) -> DataFrame:
    return events.orderBy("frame", "owner", "item")


def participants_of(timeline: Timeline, events: DataFrame | None = None, explicit: Sequence[int] = ()) -> DataFrame:
    """Owners asked for or with a snapshot, a death or an event, with name and race.

    Events that were built from the timeline's own units need not be given:
    their owners have snapshots.
    """
    race = infer_race(timeline.units)
    owners = timeline.owners.select(*K).union(death_series(timeline.deaths).select(*K))
    if events is not None:
        owners = owners.union(events.select(*K))
    if explicit:
        asked = timeline.snapshots.select(M).distinct()
        owners = owners.union(asked.select(M, F.explode(F.array(*[F.lit(int(o)) for o in explicit])).alias("owner")))
    owners = owners.distinct()
    return (
        owners.join(owner_names(timeline.owners), K, "left")
        .join(race, K, "left")
        .select(
            *K,
            F.coalesce("name", F.concat(F.lit("Player "), (F.col("owner") + 1).cast("string"))).alias("name"),
            F.coalesce("race", F.lit("unknown")).alias("race"),
        )
    )


def match_rows(timeline: Timeline, people: DataFrame) -> DataFrame:
    """Duration from the last frame, and the matchup in owner order."""
    last = timeline.snapshots.groupBy(M).agg(frame_seconds(F.max("frame")).alias("duration_seconds"))
    sides = people.groupBy(M).agg(matchup_text(F.collect_list(F.struct("owner", "race"))).alias("matchup"))
    return last.join(sides, M, "left").withColumn("map", F.lit(None).cast("string"))


class Series(Mapping):
    """Named tables, each planned when it is first asked for."""

    def __init__(self, plans: dict[str, Callable[[], DataFrame]]):
        self._plans, self._made = plans, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._plans[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def reduce_timeline(
    raw: DataFrame,
    names: DataFrame | None = None,
    *,
    owners: Sequence[int] | None = None,
    include_initial: bool = False,
    include_tech: bool = False,
    include_unit_appearances: bool = False,
    max_rows: int | None = None,
) -> Mapping[str, DataFrame]:
    """All series of a set of timelines, each planned when it is asked for.

    The series read the snapshots as they are written once.
    """
    t = Timeline(raw, owners, max_rows)
    out = Series({
        "events": lambda: build_events(
            t.units, names, include_initial=include_initial, include_tech=include_tech,
            include_unit_appearances=include_unit_appearances, max_rows=max_rows,
        ),
        "economy": lambda: economy_series(t.owners),
        "supply": lambda: supply_series(t.owners, max_rows=max_rows),
        "unit_counts": lambda: count_series(t.owners, max_rows=max_rows),
        "deaths": lambda: death_series(t.deaths),
        "participants": lambda: participants_of(t, explicit=owners or ()),
        "matches": lambda: match_rows(t, out["participants"]),
        "sampling": lambda: frame_gaps(t.snapshots, max_rows=max_rows),
    })
    return out
