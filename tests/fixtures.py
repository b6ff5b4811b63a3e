"""Small corpora built in code."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from matchlens.schema import TABLES, Corpus, with_folded


def build_corpus(spark: SparkSession, matches: list[dict], catalog=None) -> Corpus:
    """Corpus from dicts: replay_id, filename, matchup, map, duration, and players with
    events (time, item[, used, max]), economy (time, minerals, gas, workers), supply
    (time, current, max), counts (time, unit, n) and deaths (time, unit, category)."""
    rows = {n: [] for n in TABLES}
    for m in matches:
        rid = m["replay_id"]
        rows["replays"].append((rid, m.get("filename"), None, m.get("matchup"), m.get("map"), m.get("duration"), f"/m/{rid}/manifest.json"))
        for p in m["players"]:
            o = p["owner"]
            rows["players"].append((rid, o, p["name"], p["race"], f"/m/{rid}/player_{o}.zip"))
            for i, e in enumerate(p.get("events", [])):
                used, top = (e[2], e[3]) if len(e) > 2 else (None, None)
                rows["build_order_events"].append((rid, o, float(e[0]), used, top, e[1], f"{e[0]} {e[1]}", i))
            for i, e in enumerate(p.get("economy", [])):
                rows["economy_samples"].append((rid, o, float(e[0]), e[1], e[2], None, None, e[3], i))
            for i, e in enumerate(p.get("supply", [])):
                rows["supply_samples"].append((rid, o, float(e[0]), e[1], e[2], i))
            for i, e in enumerate(p.get("counts", [])):
                rows["unit_count_samples"].append((rid, o, float(e[0]), e[1], e[2], i))
            for i, e in enumerate(p.get("deaths", [])):
                rows["death_events"].append((rid, o, int(e[0] * 1000 / 42), float(e[0]), o, e[1], e[2]))
    frames = {}
    for name, ddl in TABLES.items():
        if name == "schema_metadata":
            continue
        plain = ", ".join(c for c in ddl.split(",") if not c.strip().split()[0].endswith("_lc"))
        frames[name] = with_folded(spark.createDataFrame(rows[name], plain), name)
    return Corpus(**frames, catalog=catalog)


ANALYTICS = {
    "replay_id": "replay-1", "filename": "game-one.rep", "matchup": "ZvT", "map": None, "duration": 900.0,
    "players": [
        {
            "owner": 3, "name": "pbjt", "race": "zerg",
            "events": [(118, "Hatchery"), (138, "Spawning Pool"), (216, "Lair"), (255, "Spire")],
            "economy": [(299.964, 240, 300, 24), (420, 150, 80, 31)],
            "counts": [(299.964, "drone", 24), (420, "mutalisk", 8), (420, "drone", 31), (420, "zergling", 12)],
            "deaths": [(430, "mutalisk", "unit"), (440, "zergling", "unit")],
        },
        {
            "owner": 5, "name": "Scan", "race": "terran",
            "events": [(95, "Supply Depot"), (115, "Barracks"), (225, "Factory")],
            "economy": [(299.964, 180, 96, None)],
            "counts": [(420, "marine", 14), (420, "medic", 2)],
            "deaths": [(450, "marine", "unit"), (460, "marine", "unit"), (470, "medic", "unit")],
        },
    ],
}

DISCOVERY = {
    "replay_id": "replay-d", "filename": "d.rep", "matchup": "ZvT", "map": " ", "duration": None,
    "players": [
        {
            "owner": 3, "name": "pbjt", "race": "zerg",
            "events": [(200, "Hatchery"), (235, "Spire"), (345, "Mutalisk"), (380, "Hatchery")],
            "counts": [(420, "mutalisk", 9), (420, "drone", 24)], "deaths": [(319.2, "zergling", "unit")],
        },
        {
            "owner": 5, "name": "Scan", "race": "terran", "events": [(640, "Starport"), (680, "Science Vessel")],
            "counts": [(420, "marine", 12)], "deaths": [(336, "marine", "unit")],
        },
    ],
}


def plan_match(rid: str, mutalisk: float, workers, count: int, deaths: list, vessel: float) -> dict:
    return {
        "replay_id": rid, "filename": f"{rid}.rep", "matchup": "ZvT", "map": None, "duration": 900.0,
        "players": [
            {
                "owner": 3, "name": "pbjt", "race": "zerg",
                "events": [(200, "Hatchery"), (235, "Spire"), (mutalisk, "Mutalisk", 58, 66), (450, "Hydralisk Den"), (380, "Hatchery")],
                "economy": [(234.948, 50, 100, 18), (299.964, 60, 110, workers)],
                "counts": [(420, "mutalisk", count)], "deaths": deaths,
            },
            {"owner": 5, "name": "Scan", "race": "terran", "events": [(vessel, "Science Vessel")], "deaths": [(336, "marine", "unit")]},
        ],
    }


PLAN = [
    plan_match("replay-match", 345, 24, 9, [(319.2, "zergling", "unit"), (378, "mutalisk", "air")], 680),
    plan_match("replay-reject", 365, None, 6, [(369.6, "zergling", "unit")], 660),
]


def write_bundle(path: Path, owner: int, name: str, race: str, lines: list[str], *, economy=None, drop=(), player_owner=None, counts=None, deaths=None) -> None:
    docs = {
        "player.json": json.dumps({"schema_version": "x", "owner": owner if player_owner is None else player_owner, "name": name, "race": race, "files": {}}),
        "build_order.txt": "\n".join(lines) + "\n",
        "economy.json": json.dumps({"samples": economy or []}) if not isinstance(economy, str) else economy,
        "supply.json": json.dumps({"samples": [{"frame": 0, "time_seconds": 0.0, "current": 4, "max": 9}]}),
    }
    if counts is not None:
        docs["unit_counts.json"] = json.dumps({"samples": counts})
    if deaths is not None:
        docs["deaths.json"] = json.dumps({"samples": deaths})
    with zipfile.ZipFile(path, "w") as z:
        for member, text in docs.items():
            if member not in drop:
                z.writestr(member, text)


def write_match(root: Path, folder: str, rid: str, players: list[dict], *, matchup="ZvT", version="replay-analysis-manifest-v1") -> Path:
    d = root / folder
    d.mkdir(parents=True, exist_ok=True)
    for p in players:
        write_bundle(d / f"player_{p['owner']}.zip", **p)
    manifest = {
        "schema_version": version, "replay_id": rid, "source": {"filename": f"{rid}.rep", "path": None}, "matchup": matchup,
        "map": None, "duration_seconds": 12.5,
        "players": [{"owner": p["owner"], "name": p["name"], "race": p["race"], "zip_filename": f"player_{p['owner']}.zip"} for p in players],
    }
    (d / "manifest.json").write_text(json.dumps(manifest))
    return d
