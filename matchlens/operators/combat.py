"""Loss analytics: priced events, sessions, checkpoints, milestones, heat map.

A participant's own losses are `own`, those of everyone else in the match are
`enemy`. Seen from the match as a whole every event is own to its owner, so the
operators keep one row per event with its owner and derive both sides by
subtracting from match totals where a result is an aggregate.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import loss_lane, normalize_key, titleize
from .ordered import first_n, ordered_scan, row_place
from .samples import CHECKPOINTS, catalog_by_key
from .scope import K

SESSION_GAP = 15.0
BUCKET = 5.0
TAIL_SECONDS = 5.0
TAIL_MIN = 8
TAIL_SHARE = 0.2
MATCH_SECONDS = 1.5

# Unit types with milestones at the 2nd, 5th and 10th loss.
STRATEGIC = """
scv probe drone
marine medic vulture siege_tank goliath
zealot dragoon dark_templar high_templar reaver shuttle observer
zergling hydralisk lurker mutalisk scourge defiler ultralisk
hatchery lair hive nexus command_center
""".split()
STEPS = (2, 5, 10)


def combat_events(deaths: DataFrame, catalog: DataFrame) -> DataFrame:
    """Deaths that have a lane, with normalised type, display name and cost.

    A type the catalog does not know costs nothing and is flagged. Spark
    broadcasts the catalog when its actual size allows.
    """
    rows = deaths.withColumn("lane", loss_lane("category")).where(F.col("lane").isNotNull())
    rows = rows.withColumn("unit_key", normalize_key("unit_type"))
    priced = rows.join(catalog_by_key(catalog), "unit_key", "left")
    cat = F.col("_cat")
    return priced.select(
        *[c for c in deaths.columns],
        "lane",
        "unit_key",
        F.coalesce(cat["name"], titleize("unit_key")).alias("display_name"),
        F.coalesce(cat["mineralCost"], F.lit(0)).alias("minerals"),
        F.coalesce(cat["gasCost"], F.lit(0)).alias("gas"),
        cat.isNotNull().alias("known_cost"),
    )


def seen_from(combat: DataFrame, players: DataFrame, player_owner: str = "self_owner") -> DataFrame:
    """Events as each participant of the match sees them: `side` own or enemy.

    One row per event and participant; for aggregates over both sides use
    `resource_trade`, which does not multiply events.
    """
    viewers = players.select("replay_id", F.col("owner").alias(player_owner))
    return combat.join(viewers, "replay_id").withColumn(
        "side", F.when(F.col("owner") == F.col(player_owner), "own").otherwise("enemy")
    )


def category_rank(category: Column) -> Column:
    return F.when(category == "worker", 0).when(category == "unit", 1).when(category == "building", 2).otherwise(3)


def _combat_order(events: DataFrame, original: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keyed = events.withColumn("_own", F.when(F.col("side") == "enemy", 0).otherwise(1)).withColumn("_kind", category_rank(F.col("category")))
    return keyed, ["time_seconds", "_own", "_kind", "display_name", *original]


def in_combat_order(events: DataFrame, original: Sequence[str] = ("frame",)) -> DataFrame:
    """Time, enemy first, category, display name, then the columns of the original order."""
    keyed, order = _combat_order(events, original)
    return keyed.orderBy(*order).drop("_own", "_kind")


def combat_places(
    events: DataFrame, keys: Sequence[str] = ("replay_id", "self_owner"), original: Sequence[str] = ("frame",), *, max_rows: int | None = None
) -> DataFrame:
    """Events with `place`, 1-based in combat order per viewer; matches of any size are cut into slices."""
    keyed, order = _combat_order(events, original)
    return row_place(keyed, keys, order, "place", max_rows).drop("_own", "_kind")


def _totals(extra: Sequence[Column] = ()) -> list[Column]:
    known = F.col("known_cost")
    return [
        F.count(F.lit(1)).alias("losses"),
        F.coalesce(F.sum(F.when(known, F.col("minerals"))), F.lit(0)).cast("bigint").alias("minerals"),
        F.coalesce(F.sum(F.when(known, F.col("gas"))), F.lit(0)).cast("bigint").alias("gas"),
        *extra,
    ]


def resource_trade(combat: DataFrame, until: float | None = None) -> DataFrame:
    """Per participant with losses in the match: own and enemy counts and cost.

    Enemy figures are match totals less own ones.
    """
    rows = combat if until is None else combat.where(F.col("time_seconds") <= until)
    own = rows.groupBy(*K).agg(*_totals())
    match = own.groupBy("replay_id").agg(*[F.sum(c).alias(f"_{c}") for c in ("losses", "minerals", "gas")])
    return own.join(match, "replay_id").select(
        *K,
        *[F.col(c).alias(f"own_{c}") for c in ("losses", "minerals", "gas")],
        *[(F.col(f"_{c}") - F.col(c)).alias(f"enemy_{c}") for c in ("losses", "minerals", "gas")],
    )


def cumulative_losses(combat: DataFrame, until: float) -> DataFrame:
    """Losses per participant and unit up to a time, with their cost."""
    return combat.where(F.col("time_seconds") <= until).groupBy(*K, "unit_key").agg(*_totals())


def unknown_cost_units(combat: DataFrame) -> DataFrame:
    return combat.where(~F.col("known_cost")).select("replay_id", "display_name").distinct()


def loss_sessions(
    combat: DataFrame,
    keys: Sequence[str] = ("replay_id",),
    gap: float = SESSION_GAP,
    *,
    time: str = "time_seconds",
    order: Sequence[str] = ("frame", "owner", "unit_type"),
    measures: Sequence[Column] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Runs of events at most `gap` apart: number, start, end and totals per session."""
    keys = list(keys)
    numbered = number_sessions(combat, keys, gap, time=time, order=order, max_rows=max_rows)
    aggs = list(measures) if measures is not None else _totals()
    return numbered.groupBy(*keys, "session").agg(
        F.min(time).alias("session_start"), F.max(time).alias("session_end"), *aggs
    )


def number_sessions(
    events: DataFrame,
    keys: Sequence[str],
    gap: float,
    *,
    time: str = "time_seconds",
    order: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Add a 1-based session number; a distance above `gap` opens a new session."""
    keys, at = list(keys), [time, *order]
    stepped = ordered_scan(
        events, keys, at, {"_prev": ("previous", F.col(time))}, max_rows=max_rows, keep_slice=True
    )
    opens = F.when(F.col("_prev").isNull() | (F.col(time) - F.col("_prev") > gap), 1).otherwise(0)
    return ordered_scan(
        stepped, keys, at, {"session": ("total", opens.cast("bigint"))}, max_rows=max_rows
    ).drop("_prev")


def loss_checkpoints(combat: DataFrame, times: Sequence[int] = CHECKPOINTS) -> DataFrame:
    """Cumulative losses per participant, unit and checkpoint.

    A checkpoint of a match is left out while nothing has died, and when
    nothing died since the one before. Deaths are counted once per interval
    between checkpoints and then added up, so no event is repeated.
    """
    top = max(times)
    slot = F.lit(None).cast("int")
    for i in reversed(range(len(times))):
        slot = F.when(F.col("time_seconds") <= times[i], F.lit(i)).otherwise(slot)
    rows = combat.where(F.col("time_seconds") <= top).withColumn("_slot", slot)
    cells = rows.groupBy(*K, "unit_key", "_slot").agg(*_totals())
    live = cells.select("replay_id", "_slot").distinct()
    # At most one row per checkpoint and unit from here on.
    spread = cells.select(
        *K,
        "unit_key",
        "losses",
        "minerals",
        "gas",
        F.explode(F.sequence("_slot", F.lit(len(times) - 1))).alias("_slot"),
    )
    sums = spread.groupBy(*K, "unit_key", "_slot").agg(
        *[F.sum(c).alias(c) for c in ("losses", "minerals", "gas")]
    )
    label = F.get(F.array(*[F.lit(t) for t in times]), F.col("_slot"))
    return sums.join(live, ["replay_id", "_slot"], "left_semi").select(
        *K, label.alias("checkpoint"), "unit_key", "losses", "minerals", "gas"
    )


# Labels of the category milestones.
UNIVERSAL = {"worker": "worker", "unit": "army", "building": "building"}


ORDER = ("time_seconds", "display_name", "frame")


def _milestone(rows: DataFrame, keys: Sequence[str], kind: str, label: Column) -> DataFrame:
    return rows.select(
        *keys, "time_seconds", "unit_key", "display_name", "category", F.lit(kind).alias("kind"), label.alias("label"), "n"
    )


def unit_milestones(
    combat: DataFrame, keys: Sequence[str] = K, strategic: Sequence[str] = STRATEGIC, steps: Sequence[int] = STEPS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """First loss of every unit type, later steps for the strategic ones."""
    top = first_n(combat, [*keys, "unit_key"], list(order), max((1, *steps)))
    picked = top.where((F.col("n") == 1) | (F.col("unit_key").isin(*strategic) & F.col("n").isin(*steps)))
    return _milestone(picked, keys, "unit", F.col("unit_key"))


def category_milestones(combat: DataFrame, keys: Sequence[str] = K, order: Sequence[str] = ORDER) -> DataFrame:
    """First loss of a worker, an army unit and a building."""
    label = F.lit(None).cast("string")
    for cat, name in UNIVERSAL.items():
        label = F.when(F.col("category") == cat, F.lit(name)).otherwise(label)
    first = first_n(combat.where(F.col("category").isin(*UNIVERSAL)), [*keys, "category"], list(order), 1)
    return _milestone(first, keys, "category", label)


def loss_milestones(
    combat: DataFrame, keys: Sequence[str] = K, strategic: Sequence[str] = STRATEGIC, steps: Sequence[int] = STEPS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Both kinds of milestones per participant, or per any other `keys` that name a side.

    Only the first max(steps) losses per unit and the first per category can be
    milestones, and Spark cuts to those before the shuffle.
    """
    units = unit_milestones(combat, keys, strategic, steps, order)
    return units.unionByName(category_milestones(combat, keys, order))


def seen_milestones(
    combat: DataFrame, players: DataFrame, strategic: Sequence[str] = STRATEGIC, steps: Sequence[int] = STEPS
) -> DataFrame:
    """Milestones of both sides as each participant sees them.

    A viewer's enemy list merges the losses of all others. The first few per
    unit and owner suffice for that, so only those rows meet the viewers.
    """
    keys = ["replay_id", "self_owner", "side"]
    few = first_n(combat, [*K, "unit_key"], list(ORDER), max((1, *steps))).drop("n")
    firsts = first_n(combat, [*K, "category"], list(ORDER), 1).drop("n")
    return unit_milestones(seen_from(few, players), keys, strategic, steps).unionByName(
        category_milestones(seen_from(firsts, players), keys)
    )


def loss_heatmap(combat: DataFrame, width: float = BUCKET, start: float = 0.0) -> DataFrame:
    """Losses per participant, lane and time bucket, with the largest bucket overall."""
    bucket = F.floor((F.col("time_seconds") - start) / width)
    cells = combat.where(bucket >= 0).groupBy(*K, "lane", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("losses"))
    top = cells.agg(F.greatest(F.lit(1), F.coalesce(F.max("losses"), F.lit(1))).alias("max_losses"))
    # One row.
    return (
        cells.withColumn("_one", F.lit(0))
        .join(F.broadcast(top.withColumn("_one", F.lit(0))), "_one")
        .drop("_one")
    )


def heatmap_details(combat: DataFrame, width: float = BUCKET, start: float = 0.0) -> DataFrame:
    """The units behind each bucket."""
    bucket = F.floor((F.col("time_seconds") - start) / width)
    return combat.where(bucket >= 0).groupBy(*K, "lane", bucket.alias("bucket"), "unit_key").agg(
        F.count(F.lit(1)).alias("losses")
    )


def trim_end(deaths: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Drop the mass death at the end of a participant's match.

    The tail is everything within 5 s of the last death. It goes when it has at
    least 8 deaths with a lane, at least 20 % of all, and all three lanes.
    """
    keys = list(keys)
    lane = loss_lane("category")
    # Whole-key figures come from aggregates; rows only meet one row per key.
    ends = deaths.groupBy(*keys).agg(F.max("time_seconds").alias("_end"), F.count(F.lit(1)).alias("_all"))
    near = deaths.select(*keys, "time_seconds", lane.alias("_lane")).join(ends, keys)
    tail = near.where((F.col("_end") - F.col("time_seconds") <= TAIL_SECONDS) & F.col("_lane").isNotNull())
    drop = (
        tail.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_all").alias("_all"),
            F.max("_end").alias("_end"),
            *[F.max(F.col("_lane") == x).alias(f"_{x}") for x in ("workers", "units", "buildings")],
        )
        .where(
            (F.col("_all") >= TAIL_MIN)
            & (F.col("_n") >= TAIL_MIN)
            & (F.col("_n") / F.col("_all") >= TAIL_SHARE)
            & F.col("_workers") & F.col("_units") & F.col("_buildings")
        )
        .select(*keys, "_end")
    )
    gone = F.col("_end").isNotNull() & (F.col("_end") - F.col("time_seconds") <= TAIL_SECONDS)
    return deaths.join(drop, keys, "left").where(~gone).drop("_end")


def match_intervals(
    starts: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    width: float = MATCH_SECONDS,
    *,
    start_id: str = "start_id",
    point_id: str = "point_id",
    time: str = "time_seconds",
    max_rows: int | None = None,
) -> DataFrame:
    """Give each start, in time order, the earliest unused point in [start, start+width).

    Matching is greedy, so it depends on order, but never across a quiet gap:
    starts and points are first cut into clusters wherever neighbours are more
    than `width` apart, in an ordered scan that splits hot keys. Only clusters
    holding both kinds are matched, each by itself.
    """
    keys = list(keys)
    a = starts.select(*keys, F.col(time).cast("double").alias("t"), F.lit(0).alias("kind"), F.col(start_id).cast("bigint").alias("id"))
    b = points.select(*keys, F.col(time).cast("double").alias("t"), F.lit(1).alias("kind"), F.col(point_id).cast("bigint").alias("id"))
    rows = a.unionByName(b)
    stepped = ordered_scan(
        rows, keys, ["t", "kind", "id"], {"_prev": ("previous", F.col("t"))}, max_rows=max_rows, keep_slice=True
    )
    opens = F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > width * (1 + 1e-9)), 1).otherwise(0)
    clustered = ordered_scan(
        stepped, keys, ["t", "kind", "id"], {"cluster": ("total", opens.cast("bigint"))}, max_rows=max_rows
    )
    both = (
        clustered.groupBy(*keys, "cluster").agg(F.countDistinct("kind").alias("_k")).where(F.col("_k") == 2).drop("_k")
    )
    work = clustered.join(both, [*keys, "cluster"], "left_semi").select(*keys, "cluster", "t", "kind", "id")
    schema = work.select(*keys, "id").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name != "id")
    ddl += f", {start_id} bigint, {point_id} bigint"

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted rows arrive in batches; open starts are carried over a batch edge.
        group, waiting = None, deque()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = row[: len(keys) + 1]
                if key != group:
                    group, waiting = key, deque()
                t, kind, ident = row[len(keys) + 1 :]
                if kind == 0:
                    waiting.append((t, ident))
                    continue
                while waiting and not t < waiting[0][0] + width:
                    waiting.popleft()
                if waiting:
                    out.append((*key[:-1], waiting.popleft()[1], ident))
            yield pd.DataFrame(out, columns=[*keys, start_id, point_id])

    spread = work.repartition(*keys, "cluster").sortWithinPartitions(*keys, "cluster", "t", "kind", "id")
    return spread.mapInPandas(greedy, ddl)


def drone_built(catalog: DataFrame) -> DataFrame:
    """Names of zerg buildings that consume the worker that starts them."""
    return catalog.where(
        (F.col("race") == "Zerg") & (F.col("type") == "Building") & (normalize_key("builtFrom") == "drone")
    ).select(F.lower("name").alias("item_lc")).distinct()


def classify_losses(
    deaths: DataFrame, events: DataFrame, players: DataFrame, catalog: DataFrame, *, max_rows: int | None = None
) -> DataFrame:
    """Deaths with `kind`: construction, terminal or combat.

    A zerg worker that dies as a drone-built structure starts became that
    structure. What remains is trimmed at the end of the match. `deaths` needs
    a unique `death_id` per participant and `events` an `event_seq`.
    """
    zerg = players.where(normalize_key("race") == "zerg").select(*K)
    starts = events.join(drone_built(catalog), "item_lc", "left_semi").join(zerg, K, "left_semi")
    drones = deaths.where((F.col("category") == "worker") & (normalize_key("unit_type") == "drone"))
    used = match_intervals(
        starts, drones.join(zerg, K, "left_semi"), K, start_id="event_seq", point_id="death_id", max_rows=max_rows
    ).select(*K, F.col("death_id"), F.lit("construction").alias("kind"))
    marked = deaths.join(used, [*K, "death_id"], "left")
    left = marked.where(F.col("kind").isNull()).drop("kind")
    kept = trim_end(left).select(*K, "death_id", F.lit("combat").alias("_kept"))
    return marked.join(kept, [*K, "death_id"], "left").withColumn(
        "kind", F.coalesce("kind", "_kept", F.lit("terminal"))
    ).drop("_kept")


def combat_ledger(combat: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """The parts of a match's loss report, each a table."""
    return {
        "checkpoints": loss_checkpoints(combat),
        "milestones": seen_milestones(combat, players),
        "sessions": loss_sessions(combat),
        "unknown_cost": unknown_cost_units(combat),
    }


def session_units(combat: DataFrame, gap: float = SESSION_GAP, *, max_rows: int | None = None) -> DataFrame:
    """Per session, owner and unit: losses and cost."""
    numbered = number_sessions(combat, ["replay_id"], gap, order=("frame", "owner", "unit_type"), max_rows=max_rows)
    return numbered.groupBy("replay_id", "session", "owner", "unit_key").agg(*_totals())


