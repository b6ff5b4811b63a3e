"""First, n-th and ordered events; timing distributions; event order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower_text, clock, percent
from ..sources.staging import stage
from .asof import asof_rows
from .ordered import first_n, is_small
from .quantiles import NAMES, summarize
from .scope import K, first_opponents, selfs

# Catalogs from sources up to this size may be met by broadcast as they are planned.
SMALL_CATALOG_BYTES = 1024 * 1024
EVENT = ["time_seconds", "supply_used", "supply_max", "item", "raw_line"]


def nth_per_key(
    events: DataFrame,
    keys: Sequence[str],
    n: int,
    *,
    order: Sequence[str] = ("time_seconds", "event_seq"),
) -> DataFrame:
    """The n-th row (1-based) of each key, in `order`."""
    if n < 1:
        raise ValueError("n counts from 1")
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") == n)


def first_per_key(
    events: DataFrame, keys: Sequence[str], payload: Sequence[str], *, order: Sequence[str] = ("time_seconds", "event_seq")
) -> DataFrame:
    """The earliest row of each key; a plain aggregate, combined map-side."""
    return events.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("event"))


def _of_item(events: DataFrame, item: str) -> DataFrame:
    return events.where(F.col("item_lc") == ascii_lower_text(item))


def first_event(events: DataFrame, targets: DataFrame, item: str) -> DataFrame:
    """Each target with its first event of the item, null when it has none."""
    found = first_per_key(_of_item(events, item), K, EVENT)
    return targets.join(found, K, "left")


def nth_event(events: DataFrame, targets: DataFrame, item: str, n: int) -> DataFrame:
    """Each target with its n-th event of the item, null when there are fewer."""
    found = nth_per_key(_of_item(events, item), K, n).select(*K, F.struct(*EVENT).alias("event"))
    return targets.join(found, K, "left").withColumn("n", F.lit(n))


def event_list(
    events: DataFrame,
    targets: DataFrame,
    item: str | None = None,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """All events of the targets in a closed time range, as rows."""
    rows = events if item is None else _of_item(events, item)
    if lo is not None:
        rows = rows.where(F.col("time_seconds") >= lo)
    if hi is not None:
        rows = rows.where(F.col("time_seconds") <= hi)
    return targets.join(rows.select(*K, *EVENT, "event_seq"), K)


def in_target_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("replay_id", "self_owner", "owner", "time_seconds", "event_seq")


def event_timings(
    events: DataFrame, parts: DataFrame, item: str, n: int = 1, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """n-th event time per self participant, the range applied after picking the n-th."""
    found = nth_per_key(_of_item(events, item), K, n).select(*K, "time_seconds")
    rows = selfs(parts).join(found, K)
    if lo is not None:
        rows = rows.where(F.col("time_seconds") >= lo)
    if hi is not None:
        rows = rows.where(F.col("time_seconds") <= hi)
    return rows


def event_timing_distribution(
    events: DataFrame,
    parts: DataFrame,
    item: str,
    n: int = 1,
    lo: float | None = None,
    hi: float | None = None,
    *,
    distributed: bool | None = None,
) -> DataFrame:
    """One row: sample size, five-number summary in seconds, and the same as clocks.

    `parts` comes from `scope.participants`; each participant counts as often as
    it has scope rows. Without samples the summary is null and `hint` is set.
    """
    rows = event_timings(events, parts, item, n, lo, hi)
    s = summarize(rows, "time_seconds", weight="as_self", distributed=distributed)
    return s.select(
        F.col("n").alias("sample_size"),
        "min",
        *NAMES,
        "max",
        "mean",
        *[F.when(F.col(c).isNotNull(), clock(c)).alias(f"{c}_clock") for c in ("min", *NAMES, "max")],
        F.when(F.col("n") == 0, F.lit(f'No samples found for item "{item}" with the current filters.')).alias("hint"),
    )


def with_opponents(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Attach every opponent of the self participants; null for a match of one.

    Meant for rows already cut to the wanted examples.
    """
    other = players.select(
        F.col("replay_id").alias("_m"), F.col("owner").alias("opponent_owner"), F.col("name").alias("opponent_name")
    )
    return rows.join(
        other, (F.col("replay_id") == F.col("_m")) & (F.col("opponent_owner") != F.col("owner")), "left"
    ).drop("_m")


def timing_examples(rows: DataFrame, players: DataFrame, limit: int = 5) -> DataFrame:
    """The earliest timings with their opponents, ordered by time and match."""
    order = ["time_seconds", "replay_id", "owner"]
    cut = rows.orderBy(*order).limit(limit)
    return with_opponents(cut, players).orderBy(*order, "opponent_owner").limit(limit).withColumn(
        "time", clock("time_seconds")
    )


def event_pairs(
    events: DataFrame, parts: DataFrame, a: str, b: str, na: int = 1, nb: int = 1
) -> DataFrame:
    """Per self participant the time of its na-th `a` and nb-th `b`, from one scan."""
    la, lb = ascii_lower_text(a), ascii_lower_text(b)
    top = first_n(
        events.where(F.col("item_lc").isin(la, lb)).select(*K, "item_lc", "time_seconds", "event_seq"),
        [*K, "item_lc"],
        ["time_seconds", "event_seq"],
        max(na, nb),
    )
    pair = top.groupBy(*K).agg(
        F.max(F.when((F.col("item_lc") == la) & (F.col("n") == na), F.col("time_seconds"))).alias("first_time"),
        F.max(F.when((F.col("item_lc") == lb) & (F.col("n") == nb), F.col("time_seconds"))).alias("second_time"),
    )
    return selfs(parts).join(pair, K, "left").withColumn("delta", F.col("second_time") - F.col("first_time"))


def event_before_event(
    events: DataFrame, parts: DataFrame, a: str, b: str, na: int = 1, nb: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Summary row and the per-participant pairs it counts.

    A pair matches when the first time is strictly smaller. Participants lacking
    either event are counted as missing and left out of the sample.
    """
    pairs = event_pairs(events, parts, a, b, na, nb)
    t1, t2, w = F.col("first_time"), F.col("second_time"), F.col("as_self")
    weigh = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")
    counts = pairs.agg(
        weigh(t1.isNotNull() & t2.isNotNull()).alias("sample_size"),
        weigh(t1 < t2).alias("match_count"),
        weigh(t1.isNull()).alias("missing_first_count"),
        weigh(t2.isNull()).alias("missing_second_count"),
    )
    summary = counts.withColumn("percentage", percent(F.col("match_count"), F.col("sample_size")))
    both = pairs.where(t1.isNotNull() & t2.isNotNull()).withColumn("matched", t1 < t2)
    return summary, both


def pair_examples(pairs: DataFrame, players: DataFrame, matched: bool, limit: int = 5) -> DataFrame:
    """First matching (or not matching) pairs in scope order, with clocks."""
    order = ["replay_id", "owner"]
    cut = pairs.where(F.col("matched") == matched).orderBy(*order).limit(limit)
    return (
        with_opponents(cut, players)
        .orderBy(*order, "opponent_owner")
        .limit(limit)
        .withColumn("first_clock", clock("first_time"))
        .withColumn("second_clock", clock("second_time"))
    )


# Worker names left out of a build order listing.
WORKER_ITEMS = ("SCV", "Probe", "Drone")


def build_order_with_supply(
    events: DataFrame, supply: DataFrame, *, skip: Sequence[str] = WORKER_ITEMS, max_rows: int | None = None
) -> DataFrame:
    """Every non-worker start with the supply in force at its time.

    A start before the first supply sample takes the first one.
    """
    starts = events.where(~F.col("item").isin(*skip)).select(*K, "time_seconds", "event_seq", "item")
    found = asof_rows(
        supply, starts, K, ["current", "max"], tie=["frame"], clamp=True, max_rows=max_rows
    )
    s = F.col("sample")
    return found.select(
        *K,
        "time_seconds",
        "event_seq",
        "item",
        clock("time_seconds").alias("clock"),
        F.when(s.isNull(), F.lit("--/--"))
        .otherwise(F.concat_ws("/", s["current"].cast("string"), s["max"].cast("string")))
        .alias("supply"),
    )


def chained_starts(lines: DataFrame, catalog: DataFrame, keys: Sequence[str], *, text: str = "text", line: str = "line") -> DataFrame:
    """Starts from `M:SS A -> B -> C` lines: each begins when the one before is built.

    Names unknown to the catalog are skipped and take no time. A chain is one
    line of text, so its running sum is over a handful of rows.
    """
    pattern = r"^(?:\((\d+)\)\s+)?(-?\d+):(\d{2})\s+(.+)$"
    raw = F.trim(F.col(text))
    # The names are never empty where the line fits. Only a line with a hint needs the pattern for its clock.
    names, hinted = F.regexp_extract(raw, pattern, 4), raw.startswith("(")
    minutes = F.when(hinted, F.regexp_extract(raw, pattern, 2)).otherwise(F.substring_index(raw, ":", 1))
    seconds = F.when(hinted, F.regexp_extract(raw, pattern, 3)).otherwise(raw.substr(F.length(minutes) + 2, F.lit(2)))
    sign = F.when(minutes.startswith("-"), -1).otherwise(1)
    parsed = lines.where(names != "").select(
        *keys,
        F.col(line).alias("line"),
        F.when(hinted, F.regexp_extract(raw, pattern, 1).cast("int") - 1).otherwise(0).alias("track"),
        (sign * (F.abs(minutes.cast("int")) * 60 + seconds.cast("int"))).alias("_t0"),
        F.posexplode(F.split(names, r"\s*->\s*")).alias("link", "_name"),
    )
    dim = catalog.groupBy(F.lower("name").alias("_key")).agg(
        F.min_by(F.struct("name", "race", "type", "buildTime", "builtFrom"), "name").alias("_d")
    )
    # As a table of its own, what is left of a large catalog shows its size, and lines need no shuffle to meet a small one.
    if not is_small(dim, SMALL_CATALOG_BYTES):
        dim = stage(dim, "catalog")
    known = parsed.withColumn("_key", F.lower(F.trim("_name"))).join(dim, "_key")
    # No line is hot, so none is counted.
    chain = Window.partitionBy(*keys, "line").orderBy("link").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = known.withColumn("_b", F.col("_d")["buildTime"]).withColumn("_total", F.sum("_b").over(chain))
    return out.select(
        *keys,
        "line",
        "link",
        "track",
        F.col("_d")["name"].alias("item"),
        F.col("_d")["race"].alias("race"),
        F.col("_d")["type"].alias("type"),
        F.col("_b").alias("build_time"),
        F.col("_d")["builtFrom"].alias("built_from"),
        (F.col("_t0") + F.col("_total") - F.col("_b")).alias("time_seconds"),
    )


def first_opponent_of(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Attach only the first opponent of each row."""
    other = first_opponents(players)
    joined = rows.join(
        other, (F.col("replay_id") == F.col("_m")) & (F.col("opponent_owner") != F.col("owner")), "left"
    ).drop("_m")
    w = Window.partitionBy("replay_id", "owner").orderBy(F.col("opponent_owner").asc_nulls_first())
    return joined.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
