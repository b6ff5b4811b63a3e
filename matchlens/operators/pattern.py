"""Pattern search: constraints and requested evidence in one fused job.

Every constraint and evidence request names facts: an n-th event, a count or an
economy sample at a time, losses in a window. Facts are collected once, each
table is scanned once for all of its facts, and the results, one row per
participant, are attached to the searched player's matches: once as self, once
as enemy. Facts at an event's own time need a second look at the sample table,
which joins one probe row per match and side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower_text
from ..schema import Corpus
from .asof import latest_when
from .events import EVENT
from .losses import fold_counts
from .ordered import first_n, hold
from .samples import ECONOMY
from .scope import K, in_matches, perspective

SUMMARIES = ("total_count", "count_by_unit_type", "count_by_category", "first_time_seconds", "last_time_seconds")


@dataclass(frozen=True)
class Event:
    """The n-th event of an item, on the player's side or the enemy's."""

    item: str
    n: int = 1
    side: str = "self"


@dataclass(frozen=True)
class EventBefore:
    id: str
    event: Event
    seconds: float


@dataclass(frozen=True)
class EventAfter:
    id: str
    event: Event
    seconds: float


@dataclass(frozen=True)
class UnitCountAt:
    """Count bounds at a time; the sample must exist, and a real 0 counts."""

    id: str
    unit: str
    at: float
    at_least: float | None = None
    at_most: float | None = None
    side: str = "self"


@dataclass(frozen=True)
class WorkersAt:
    """Worker bounds on the latest sample; null workers fail."""

    id: str
    at: float
    at_least: float | None = None
    at_most: float | None = None
    side: str = "self"


@dataclass(frozen=True)
class LossesBetween:
    """Bounds on losses in a closed window; no losses count as 0."""

    id: str
    lo: float
    hi: float
    at_least: float | None = None
    at_most: float | None = None
    side: str = "self"


@dataclass(frozen=True)
class EventBeforeEvent:
    id: str
    left: Event
    right: Event


@dataclass(frozen=True)
class ShowEvent:
    id: str
    event: Event


@dataclass(frozen=True)
class ShowUnitCount:
    id: str
    unit: str
    at: float
    side: str = "self"


@dataclass(frozen=True)
class ShowEconomy:
    id: str
    at: float
    side: str = "self"


@dataclass(frozen=True)
class ShowLosses:
    id: str
    lo: float
    hi: float
    summaries: Sequence[str] = ("total_count",)
    side: str = "self"


@dataclass(frozen=True)
class ShowEconomyAtEvent:
    id: str
    event: Event
    side: str = "self"


@dataclass(frozen=True)
class ShowUnitCountAtEvent:
    id: str
    unit: str
    event: Event
    side: str = "self"


Constraint = EventBefore | EventAfter | UnitCountAt | WorkersAt | LossesBetween | EventBeforeEvent
Evidence = ShowEvent | ShowUnitCount | ShowEconomy | ShowLosses | ShowEconomyAtEvent | ShowUnitCountAtEvent


@dataclass
class _Facts:
    """Distinct facts per table, each with a short column name."""

    events: dict = field(default_factory=dict)
    units: dict = field(default_factory=dict)
    economy: dict = field(default_factory=dict)
    losses: dict = field(default_factory=dict)

    def event(self, e: Event) -> str:
        return self.events.setdefault((ascii_lower_text(e.item), e.n), f"ev{len(self.events)}")

    def unit(self, unit: str, at: float) -> str:
        return self.units.setdefault((ascii_lower_text(unit), float(at)), f"uc{len(self.units)}")

    def eco(self, at: float) -> str:
        return self.economy.setdefault(float(at), f"ec{len(self.economy)}")

    def loss(self, lo: float, hi: float) -> str:
        return self.losses.setdefault((float(lo), float(hi)), f"de{len(self.losses)}")


def event_facts(events: DataFrame, wanted: dict) -> DataFrame:
    """One struct column per (item, n), one row per participant, one scan."""
    items = sorted({item for item, _ in wanted})
    rows = events.where(F.col("item_lc").isin(*items)).select(*K, "item_lc", "event_seq", *EVENT)
    deepest = max(n for _, n in wanted)
    top = first_n(rows, [*K, "item_lc"], ["time_seconds", "event_seq"], deepest)
    return top.groupBy(*K).agg(
        *[
            F.max(F.when((F.col("item_lc") == item) & (F.col("n") == n), F.struct(*EVENT))).alias(name)
            for (item, n), name in wanted.items()
        ]
    )


def unit_facts(counts: DataFrame, wanted: dict) -> DataFrame:
    rows = counts.where(
        F.col("unit_type_lc").isin(*sorted({u for u, _ in wanted}))
        & (F.col("time_seconds") <= max(t for _, t in wanted))
    )
    return rows.groupBy(*K).agg(
        *[
            latest_when(
                (F.col("unit_type_lc") == u) & (F.col("time_seconds") <= t),
                ["time_seconds", "unit_type", "count"],
                ["time_seconds", "frame"],
            ).alias(name)
            for (u, t), name in wanted.items()
        ]
    )


def economy_facts(economy: DataFrame, wanted: dict) -> DataFrame:
    rows = economy.where(F.col("time_seconds") <= max(wanted))
    return rows.groupBy(*K).agg(
        *[
            latest_when(F.col("time_seconds") <= t, ["time_seconds", *ECONOMY], ["time_seconds", "frame"]).alias(name)
            for t, name in wanted.items()
        ]
    )


LOSS_FIELDS = "total_count", "count_by_unit_type", "count_by_category", "first_time_seconds", "last_time_seconds"


def loss_facts(deaths: DataFrame, wanted: dict, maps: bool = True) -> DataFrame:
    """Per window a struct of count, first and last time, and histograms.

    Rows are first reduced to one per (participant, unit, category), so the
    maps are bounded by the vocabulary.
    """
    t = F.col("time_seconds")
    inside = {name: t.between(lo, hi) for (lo, hi), name in wanted.items()}
    span = t.between(min(lo for lo, _ in wanted), max(hi for _, hi in wanted))
    cells = deaths.where(span).groupBy(*K, "unit_type", "category").agg(
        *[F.count_if(c).alias(f"{n}_c") for n, c in inside.items()],
        *[F.min(F.when(c, t)).alias(f"{n}_t0") for n, c in inside.items()],
        *[F.max(F.when(c, t)).alias(f"{n}_t1") for n, c in inside.items()],
    )
    outs = []
    for n in inside:
        c = F.col(f"{n}_c")
        parts = [
            F.sum(c).alias("total_count"),
            F.min(f"{n}_t0").alias("first_time_seconds"),
            F.max(f"{n}_t1").alias("last_time_seconds"),
        ]
        if maps:
            pairs = F.collect_list(F.when(c > 0, F.struct("unit_type", "category", c.alias("c"))))
            parts += [fold_counts(pairs, "unit_type").alias("count_by_unit_type"), fold_counts(pairs, "category").alias("count_by_category")]
        outs.append(F.struct(*parts).alias(n))
    return cells.groupBy(*K).agg(*outs)


def _bound(value: Column, at_least: float | None, at_most: float | None) -> Column:
    cond = F.lit(True)
    if at_least is not None:
        cond = cond & (value >= at_least)
    if at_most is not None:
        cond = cond & (value <= at_most)
    return F.coalesce(cond, F.lit(False))


def _check(constraints: Sequence[Constraint], evidence: Sequence[Evidence]) -> None:
    seen: set[str] = set()
    for item in (*constraints, *evidence):
        if item.id in seen:
            raise ValueError(f"duplicate id: {item.id}")
        seen.add(item.id)
        sides = [getattr(item, "side", "self")] + [e.side for e in vars(item).values() if isinstance(e, Event)]
        if any(s not in ("self", "enemy") for s in sides):
            raise ValueError(f"{item.id}: side must be 'self' or 'enemy'")
        if isinstance(item, (LossesBetween, ShowLosses)) and item.lo > item.hi:
            raise ValueError(f"{item.id}: lo must not exceed hi")
        if isinstance(item, ShowLosses):
            unknown = set(item.summaries) - set(SUMMARIES)
            if unknown:
                raise ValueError(f"{item.id}: unknown summaries {sorted(unknown)}")


def pattern_search(
    corpus: Corpus,
    *,
    player: str,
    matchup: str | None = None,
    race: str | None = None,
    ids: Sequence | None = None,
    constraints: Sequence[Constraint] = (),
    evidence: Sequence[Evidence] = (),
    debug: bool = False,
) -> DataFrame:
    """One row per match: `matched`, a boolean `c_<id>` and value `v_<id>` per
    constraint, and `e_<id>` per evidence request.

    Where a name fits several participants, or there are several opponents, the
    first self row and its first opponent are used; facts at an event's time
    need exactly one of each. Only matches that pass are returned; with `debug`
    all are, and the evidence of rejected ones is null.
    """
    _check(constraints, evidence)
    facts = _Facts()
    for c in constraints:
        if isinstance(c, (EventBefore, EventAfter)):
            facts.event(c.event)
        elif isinstance(c, EventBeforeEvent):
            facts.event(c.left), facts.event(c.right)
        elif isinstance(c, UnitCountAt):
            facts.unit(c.unit, c.at)
        elif isinstance(c, WorkersAt):
            facts.eco(c.at)
        else:
            facts.loss(c.lo, c.hi)
    for e in evidence:
        if isinstance(e, (ShowEvent, ShowEconomyAtEvent, ShowUnitCountAtEvent)):
            facts.event(e.event)
        elif isinstance(e, ShowUnitCount):
            facts.unit(e.unit, e.at)
        elif isinstance(e, ShowEconomy):
            facts.eco(e.at)
        else:
            facts.loss(e.lo, e.hi)

    who = perspective(corpus.players, player=player, race=race)
    base = in_matches(corpus.replays, who, matchup=matchup, ids=ids)
    sides = base.select(
        "replay_id",
        F.explode(
            F.array(
                F.struct(F.lit("self").alias("side"), F.col("self_owner").alias("owner")),
                F.struct(F.lit("enemy").alias("side"), F.col("enemy_owner").alias("owner")),
            )
        ).alias("s"),
    ).select("replay_id", "s.side", "s.owner").where(F.col("owner").isNotNull())
    maps = any(
        isinstance(e, ShowLosses) and {"count_by_unit_type", "count_by_category"} & set(e.summaries) for e in evidence
    )
    names: list[str] = []
    per_side = sides
    for table, wanted, build in (
        ("build_order_events", facts.events, event_facts),
        ("unit_count_samples", facts.units, unit_facts),
        ("economy_samples", facts.economy, economy_facts),
        ("death_events", facts.losses, lambda d, w: loss_facts(d, w, maps)),
    ):
        if wanted:
            rows = getattr(corpus, table).join(sides.select(*K), K, "left_semi")
            per_side = per_side.join(build(rows, wanted), K, "left")
            names += wanted.values()
    if names:
        # Two rows per match come together on the match.
        pick = lambda side, n: F.first(F.when(F.col("side") == side, F.col(n)), ignorenulls=True).alias(f"{side}_{n}")
        both = per_side.groupBy("replay_id").agg(*[pick(s, n) for s in ("self", "enemy") for n in names])
        base = base.join(both, "replay_id", "left")

    def ev(e: Event) -> Column:
        return F.col(f"{e.side}_{facts.event(e)}")

    out = base
    passed = F.lit(True)
    shown: list[Column] = []
    for c in constraints:
        if isinstance(c, EventBefore):
            value, ok = ev(c.event), ev(c.event)["time_seconds"] < c.seconds
        elif isinstance(c, EventAfter):
            value, ok = ev(c.event), ev(c.event)["time_seconds"] > c.seconds
        elif isinstance(c, EventBeforeEvent):
            value = F.struct(ev(c.left).alias("left_event"), ev(c.right).alias("right_event"))
            ok = ev(c.left)["time_seconds"] < ev(c.right)["time_seconds"]
        elif isinstance(c, UnitCountAt):
            value = F.col(f"{c.side}_{facts.unit(c.unit, c.at)}")
            ok = _bound(value["count"], c.at_least, c.at_most) & value.isNotNull()
        elif isinstance(c, WorkersAt):
            value = F.col(f"{c.side}_{facts.eco(c.at)}")
            ok = _bound(value["workers"], c.at_least, c.at_most) & value["workers"].isNotNull()
        else:
            value = F.coalesce(F.col(f"{c.side}_{facts.loss(c.lo, c.hi)}")["total_count"], F.lit(0))
            ok = _bound(value, c.at_least, c.at_most)
        ok = F.coalesce(ok, F.lit(False))
        passed = passed & ok
        shown += [ok.alias(f"c_{c.id}"), value.alias(f"v_{c.id}")]

    out = out.select(*[c for c in out.columns], *shown, passed.alias("matched"))
    if not debug:
        out = out.where("matched")

    keep: list[Column] = []
    if any(isinstance(e, (ShowEconomyAtEvent, ShowUnitCountAtEvent)) for e in evidence):
        # The second look at the samples concerns matched rows only.
        out = hold(out)
    for e in evidence:
        if isinstance(e, ShowEvent):
            value = ev(e.event)
        elif isinstance(e, ShowUnitCount):
            value = F.col(f"{e.side}_{facts.unit(e.unit, e.at)}")
        elif isinstance(e, ShowEconomy):
            value = F.col(f"{e.side}_{facts.eco(e.at)}")
        elif isinstance(e, ShowLosses):
            value = _losses_shown(F.col(f"{e.side}_{facts.loss(e.lo, e.hi)}"), e.summaries)
        else:
            out = _at_event(out, corpus, e, ev(e.event))
            value = F.when(
                ev(e.event).isNotNull(), F.struct(ev(e.event).alias("event"), F.col(f"_s_{e.id}").alias("sample"))
            )
        keep.append(F.when(F.col("matched"), value).alias(f"e_{e.id}"))

    final = [
        "replay_id", "source_replay_filename", "source_replay_path", "matchup",
        F.col("only_self_name").alias("self_player_name"), F.col("only_self").alias("self_owner"),
        F.col("only_enemy_name").alias("enemy_player_name"), F.col("only_enemy").alias("enemy_owner"), "matched",
    ]
    consts = [f"{p}_{c.id}" for c in constraints for p in ("c", "v")]
    return out.select(*final, *consts, *keep)


def _losses_shown(value: Column, summaries: Sequence[str]) -> Column:
    empty = F.create_map().cast("map<string,bigint>")
    defaults = {"total_count": F.lit(0).cast("bigint"), "count_by_unit_type": empty, "count_by_category": empty}
    return F.struct(
        *[F.coalesce(value[s], defaults[s]).alias(s) if s in defaults else value[s].alias(s) for s in summaries]
    )


def _at_event(out: DataFrame, corpus: Corpus, e, event: Column) -> DataFrame:
    """Add `_s_<id>`: the sample in force on the asked side at the event's time.

    Both identities must be unique. The probe side has one row per match, so
    the join keeps each sample row at most once and the aggregate combines
    map-side.
    """
    probes = out.where(F.col("matched") & event.isNotNull()).select(
        "replay_id", F.col(f"only_{e.side}").alias("owner"), event["time_seconds"].alias("_at")
    ).where(F.col("owner").isNotNull())
    if isinstance(e, ShowEconomyAtEvent):
        rows, payload = corpus.economy_samples, ["time_seconds", *ECONOMY]
    else:
        rows = corpus.unit_count_samples.where(F.col("unit_type_lc") == ascii_lower_text(e.unit))
        payload = ["time_seconds", "unit_type", "count"]
    found = (
        rows.join(probes, K)
        .where(F.col("time_seconds") <= F.col("_at"))
        .groupBy("replay_id")
        .agg(F.max_by(F.struct(*payload), F.struct("time_seconds", "frame")).alias(f"_s_{e.id}"))
    )
    return out.join(found, "replay_id", "left")


def find_candidates(
    corpus: Corpus,
    *,
    player: str,
    item_a: str,
    before_a: float,
    item_b: str,
    before_b: float,
    unit: str,
    count_at: float,
    economy_at: float,
    lo: float,
    hi: float,
    matchup: str | None = None,
    race: str | None = None,
    ids: Sequence | None = None,
) -> DataFrame:
    """Matches where the player's first A comes before `before_a` and the enemy's
    first B before `before_b`, with counts, economy and both sides' losses.

    One row per own participant row that has an early A; with several opponents
    the last one speaks for the enemy, and with several own rows the last one
    supplies the samples.
    """
    facts = _Facts()
    a, b = facts.event(Event(item_a)), facts.event(Event(item_b))
    uc, ec, de = facts.unit(unit, count_at), facts.eco(economy_at), facts.loss(lo, hi)
    who = perspective(corpus.players, player=player, race=race, last=True).select(
        "replay_id", F.col("self_owner").alias("last_self"), "enemy_owner"
    )
    matches = in_matches(corpus.replays, who.where(F.col("enemy_owner").isNotNull()), matchup=matchup, ids=ids)
    cond = F.col("name_lc") == ascii_lower_text(player)
    if race is not None:
        cond = cond & (F.col("race_lc") == ascii_lower_text(race))
    own = corpus.players.where(cond).select("replay_id", F.col("owner").alias("player_owner"), F.col("name").alias("player_name"))
    keys = matches.select("replay_id")

    def near(df: DataFrame) -> DataFrame:
        return df.join(keys, "replay_id", "left_semi")

    events = event_facts(near(corpus.build_order_events), facts.events)
    first_a = events.where(F.col(a)["time_seconds"] < before_a).select(
        "replay_id", F.col("owner").alias("player_owner"), F.col(a).alias("first_a")
    )
    first_b = events.where(F.col(b)["time_seconds"] < before_b).select(
        "replay_id", F.col("owner").alias("enemy_owner"), F.col(b).alias("first_b")
    )
    hits = (
        matches.join(own, "replay_id")
        .join(first_a, ["replay_id", "player_owner"])
        .join(first_b, ["replay_id", "enemy_owner"])
    )
    enemy = corpus.players.select("replay_id", F.col("owner").alias("enemy_owner"), F.col("name").alias("enemy_name"))
    hits = hits.join(enemy, ["replay_id", "enemy_owner"])
    units = unit_facts(near(corpus.unit_count_samples), facts.units).select("replay_id", F.col("owner").alias("last_self"), F.col(uc).alias("count_at"))
    eco = economy_facts(near(corpus.economy_samples), facts.economy).select("replay_id", F.col("owner").alias("last_self"), F.col(ec).alias("economy_at"))
    losses = loss_facts(near(corpus.death_events), facts.losses)
    mine = losses.select("replay_id", F.col("owner").alias("last_self"), F.col(de).alias("_own"))
    theirs = losses.select("replay_id", F.col("owner").alias("enemy_owner"), F.col(de).alias("_enemy"))
    out = (
        hits.join(units, ["replay_id", "last_self"], "left")
        .join(eco, ["replay_id", "last_self"], "left")
        .join(mine, ["replay_id", "last_self"], "left")
        .join(theirs, ["replay_id", "enemy_owner"], "left")
    )
    return out.select(
        "replay_id", "source_replay_filename", "source_replay_path", "matchup", "player_name", "player_owner",
        "enemy_name", "enemy_owner", "first_a", "first_b", "count_at", "economy_at",
        _losses_shown(F.col("_own"), SUMMARIES[:3]).alias("self_losses"),
        _losses_shown(F.col("_enemy"), SUMMARIES[:3]).alias("enemy_losses"),
    )


def evidence_losses(
    corpus: Corpus, result: DataFrame, request: ShowLosses, *, player: str, race: str | None = None
) -> DataFrame:
    """The deaths behind a losses request, as rows of the matched matches."""
    who = perspective(corpus.players, player=player, race=race).select(
        "replay_id", F.col(f"{request.side}_owner").alias("owner")
    )
    hit = result.where("matched").select("replay_id").join(who, "replay_id").where(F.col("owner").isNotNull())
    rows = corpus.death_events.where(F.col("time_seconds").between(request.lo, request.hi))
    return rows.join(hit, K, "left_semi")
