"""Column expressions: clocks, labels, names, races, flags.

Everything here is a built-in expression tree, so it stays inside
whole-stage code generation and never crosses into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_MS = 42

# Names of the three participant types.
RACES = ("terran", "zerg", "protoss")

# Display names that do not follow the title-case rule.
SPECIAL_DISPLAY = {
    "scv": "SCV",
    "emp_shockwave": "EMP Shockwave",
    "u_238_shells": "U-238 Shells",
}

# Unit types that never count as output.
TRANSIENT_TYPES = ("egg", "cocoon", "lurker_egg")
IGNORED_CATEGORIES = ("resource", "subunit", "powerup")
OMITTED_OUTPUT_TYPES = (
    "goliath_turret",
    "schezar_turret",
    "siege_tank_turret",
    "edmund_duke_tank_turret",
    "edmund_duke_siege_turret",
    "siege_tank_siege_turret",
)
TYPE_ALIASES = {"siege_tank_tank": "siege_tank"}

# Bit positions of the unit flag word.
FLAG_BITS = {
    "completed": 0,
    "morphing_building": 2,
    "constructing_building": 3,
    "disabled": 4,
    "burrowed": 5,
    "cloaked_or_burrowed": 6,
    "hallucination": 7,
    "in_transport": 8,
    "in_bunker": 9,
    "lifted": 10,
}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_lower(value: Column | str) -> Column:
    """Fold A-Z only, so that case-insensitive equality leaves other letters alone."""
    return F.translate(_c(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower_text(value: str) -> str:
    """The same folding for a literal on the driver."""
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in value)


def clock(seconds: Column | str) -> Column:
    """`m:ss`, rounded half up; missing or non-finite input reads "unknown"."""
    s = _c(seconds).cast("double")
    whole = F.greatest(F.lit(0.0), F.floor(s + 0.5)).cast("bigint")
    text = F.concat(
        F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    return F.when(finite, text).otherwise(F.lit("unknown"))


def padded_clock(seconds: Column | str) -> Column:
    """`mm:ss`, floored; missing input reads as an empty string."""
    whole = F.floor(_c(seconds).cast("double")).cast("bigint")
    text = F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)
    return F.when(whole.isNull(), F.lit("")).otherwise(text)


def frame_seconds(frame: Column | str) -> Column:
    return _c(frame).cast("bigint") * FRAME_MS / F.lit(1000.0)


def normalize_key(value: Column | str) -> Column:
    """Lower-case identifier: runs of other characters become one underscore."""
    body = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(value), F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(body, "^_+|_+$", "")


def display_name(value: Column | str) -> Column:
    """Title form of a snake_case name, with the fixed exceptions."""
    v = _c(value)
    titled = F.regexp_replace(F.initcap(F.translate(v, "_", " ")), r"\bIi\b", "II")
    out = titled
    for raw, shown in SPECIAL_DISPLAY.items():
        out = F.when(v == raw, F.lit(shown)).otherwise(out)
    return out


def titleize(value: Column | str) -> Column:
    """Capitalise each non-empty underscore part and leave the rest of it as is."""
    parts = F.filter(F.split(F.coalesce(_c(value), F.lit("")), "_"), lambda p: p != "")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))),
        " ",
    )


def normalize_type(value: Column | str) -> Column:
    out = _c(value)
    for raw, name in TYPE_ALIASES.items():
        out = F.when(_c(value) == raw, F.lit(name)).otherwise(out)
    return out


def is_omitted_type(value: Column | str) -> Column:
    return _c(value).isin(*OMITTED_OUTPUT_TYPES)


def is_building_id(type_id: Column | str) -> Column:
    return _c(type_id).between(106, 172)


def unit_race(unit_type: Column | str, type_id: Column | str) -> Column:
    """Race from the name prefix, else from the fixed id ranges, else null."""
    name, uid = _c(unit_type), _c(type_id)
    prefix = F.regexp_extract(F.coalesce(name, F.lit("")), "^(terran|zerg|protoss)_", 1)
    # Id ranges per race.
    by_id = (
        F.when(uid.between(0, 34) | uid.between(106, 130), "terran")
        .when(uid.between(35, 58) | uid.between(97, 103) | uid.between(131, 152), "zerg")
        .when(uid.between(59, 83) | uid.between(154, 172), "protoss")
    )
    return F.when(prefix != "", prefix).otherwise(by_id)


def decode_flags(flags: Column | str) -> dict[str, Column]:
    word = _c(flags)
    return {name: F.shiftright(word, bit).bitwiseAND(F.lit(1)) == 1 for name, bit in FLAG_BITS.items()}


def race_initial(race: Column | str) -> Column:
    """First letter in upper case; a blank race reads "?"."""
    r = F.coalesce(_c(race), F.lit("unknown"))
    return F.when(r == "", F.lit("?")).otherwise(F.upper(F.substring(r, 1, 1)))


def matchup_text(players: Column | str) -> Column:
    """Initials joined by "v" from an array of structs that start with the owner."""
    return F.array_join(F.transform(F.array_sort(_c(players)), lambda p: race_initial(p["race"])), "v")


def matchup_or_null(players: Column | str) -> Column:
    """Like `matchup_text`, but null unless every race is one of the three."""
    codes = F.transform(
        F.array_sort(_c(players)),
        lambda p: F.when(ascii_lower(F.trim(p["race"])).isin(*RACES), F.upper(F.substring(F.trim(p["race"]), 1, 1))),
    )
    known = (F.size(codes) > 0) & ~F.exists(codes, lambda x: x.isNull())
    return F.when(known, F.array_join(codes, "v"))


def supply_state(current: Column | str, maximum: Column | str) -> Column:
    cur, top = _c(current), _c(maximum)
    return (
        F.when(top.isNull() | cur.isNull(), "zero")
        .when((top == 0) & (cur > 0), "over")
        .when(top == 0, "zero")
        .when(cur >= top, "capped")
        .when(cur / top >= 0.9, "warn")
        .otherwise("ok")
    )


def supply_severity(state: Column | str) -> Column:
    s = _c(state)
    return F.when(s == "over", 3).when(s == "capped", 2).when(s == "warn", 1).otherwise(0)


def loss_lane(category: Column | str) -> Column:
    """workers / units / buildings; any other category has no lane."""
    c = _c(category)
    return (
        F.when(c == "worker", "workers").when(c.isin("unit", "air"), "units").when(c == "building", "buildings")
    )


def content_id(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 100, 1))


def per_match(count: Column, matches: Column) -> Column:
    """Mean to two decimals; 0 when there are no matches."""
    return F.when(matches == 0, F.lit(0.0)).otherwise(F.round(count / matches, 2))
