"""Files in, tables out: ingest, timelines, listings, exports."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pandas as pd
from fixtures import write_bundle, write_match
from pyspark.sql import functions as F

from matchlens.operators import events, reduction, samples, scope
from matchlens.schema import open_corpus
from matchlens.sources import bundles, inventory, sinks, staging, timelines


def eco(t, workers=None):
    return {"frame": int(t / 0.042), "time_seconds": t, "minerals": 50, "gas": 0, "workers": workers}


def player(owner, name, race, lines, **kw):
    return {"owner": owner, "name": name, "race": race, "lines": lines, **kw}


def test_ingest_and_replace(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "corpus")
    write_match(root, "b/one", "m1", [
        player(3, "pbjt", "zerg", ["06:00 [58/66] Mutalisk", "", "  04:10 Spire  "], economy=[eco(1.0, 4), eco(2.0)],
               counts=[{"frame": 1, "time_seconds": 12.6, "counts": {"mutalisk": 0}}, {"frame": 2, "time_seconds": 16.8, "counts": {"mutalisk": 3}}],
               deaths=[{"frame": 9, "time_seconds": 0.378, "death": {"id": 1, "owner": 3, "unit_type": "drone", "category": "worker"}}]),
        player(5, "Scan", "terran", ["11:30 Science Vessel"]),
    ])
    write_bundle(root / "b/one/stray.zip", 9, "stray", "zerg", ["00:01 Drone"])
    write_match(root, "a/two", "m2", [player(1, "x", "zerg", ["00:10 Drone"])])
    write_match(root, "bad/line", "m3", [player(1, "x", "zerg", ["00:10 Drone", "99 nonsense"])])
    write_match(root, "bad/owner", "m4", [player(1, "x", "zerg", ["00:10 Drone"], player_owner=2)])
    write_match(root, "bad/member", "m5", [player(1, "x", "zerg", ["00:10 Drone"], drop=("supply.json",))])
    write_match(root, "bad/json", "m6", [player(1, "x", "zerg", ["00:10 Drone"], economy="{broken")])
    d = write_match(root, "bad/gone", "m7", [player(1, "x", "zerg", ["00:10 Drone"])])
    (d / "player_1.zip").unlink()
    (root / "bad/text").mkdir()
    (root / "bad/text/manifest.json").write_text("{nope")
    d = write_match(root, "bad/zip", "m8", [player(1, "x", "zerg", ["00:10 Drone"])])
    (d / "player_1.zip").write_bytes(b"no archive")
    report = sinks.ingest(spark, str(root), store, buckets=3)
    reasons = {(r.replay_id, r.reason.split(":")[0]) for r in report["errors"].collect()}
    assert reasons == {
        ("m3", "invalid line"), ("m4", "player.json owner 2 does not match manifest owner 1"),
        ("m5", "missing required bundle file supply.json"), ("m6", "invalid JSON in economy.json"), ("m7", "archive not found"),
        ("m8", "unreadable archive"), (None, "malformed manifest"),
    }
    c = open_corpus(spark, store)
    assert {r.replay_id for r in c.replays.collect()} == {"m1", "m2"}
    got = [(r.time_seconds, r.supply_used, r.supply_max, r.item, r.event_seq) for r in c.build_order_events.where("replay_id = 'm1'").orderBy("owner", "event_seq").collect()]
    assert got == [(360.0, 58, 66, "Mutalisk", 0), (250.0, None, None, "Spire", 2), (690.0, None, None, "Science Vessel", 0)]
    who = scope.targets(c.players, c.replays, player="PBJT")
    assert samples.unit_count_at(c.unit_count_samples, who, "Mutalisk", 17).first().sample["count"] == 3
    assert samples.economy_at(c.economy_samples, who, 5).first().sample.workers is None
    assert c.death_events.first().category == "worker"

    # The same match again with other contents: replaced, not added; the rest stays.
    write_match(root, "b/one", "m1", [player(3, "pbjt", "zerg", ["05:30 Mutalisk"], economy=[eco(1.0), eco(2.0)]), player(5, "Scan", "terran", ["11:30 Science Vessel"])])
    for _ in range(2):
        sinks.ingest(spark, str(root), store, buckets=3)
    c = open_corpus(spark, store)
    assert c.economy_samples.where("replay_id = 'm1'").count() == 2
    first = events.first_event(c.build_order_events, scope.targets(c.players, c.replays, player="pbjt"), "mutalisk").first()
    assert first.event.time_seconds == 330
    assert c.replays.count() == 2 and c.players.count() == 3 and c.death_events.count() == 0


def test_missing_tables_are_named(spark, tmp_path):
    try:
        open_corpus(spark, str(tmp_path))
        raise AssertionError("must fail")
    except ValueError as e:
        assert "replays" in str(e) and "death_events" in str(e)


def test_batches_and_duplicates(spark):
    rows = spark.createDataFrame([(f"/x/{i:02d}/manifest.json", f"r{i}") for i in range(21)], "manifest_path string, replay_id string")
    got = sinks.batch_report(rows, 10).orderBy("batch_number").collect()
    assert [r.manifest_count for r in got] == [10, 10, 1] and [r.manifests_remaining for r in got] == [11, 1, 0]
    assert got[0].replay_ids[:2] == ["r0", "r1"]
    twice = spark.createDataFrame([("r", "/b/manifest.json", 2), ("r", "/a/manifest.json", 1)], "replay_id string, manifest_path string, v int")
    assert bundles.latest_manifests(twice).first().v == 2


def pack(value) -> bytes:
    """Packed form of small values, for fixtures."""
    if value is None:
        return b"\xc0"
    if isinstance(value, int):
        return struct.pack(">B", value) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\xd9" + struct.pack(">B", len(raw)) + raw
    return b"\xdc" + struct.pack(">H", len(value)) + b"".join(pack(v) for v in value)


UNIT = [1, 3, 1, None, None, 4, 5, 15360, 0, 12800, 10, 20, 10, 20, 0, 0, 0, 0, 3, 0, 0, 23, 0, 0, 0, 0, 0, [], [7], None, None, None, None]


def test_packed_timeline(spark, tmp_path):
    header = [0, "sbtl", 2, ["building", "worker", "resource", "powerup", "subunit", "air", "unit"], ["marine", "goliath_turret", "siege_tank_tank", "command_center"]]
    snap = [1, 24, [[3, "WorkerRush", 50, 0, 8, 4, 4, 10, 4, [2, 1, 3, 1], [UNIT]]], [UNIT]]
    (tmp_path / "a.sbtl").write_bytes(pack(header) + pack(snap) + pack([1, 25, [], []]))
    old = [1, 2, [[4, "v1", 1, 2, 3, 9, 5, [], []]], []]
    (tmp_path / "v1.sbtl").write_bytes(pack([0, "sbtl", 1, *header[3:]]) + pack(old))
    (tmp_path / "cut.sbtl").write_bytes(pack(header) + pack(snap)[:-5])
    (tmp_path / "bad.sbtl").write_bytes(b"\x93\x01")
    files = timelines.read_files(spark, str(tmp_path), "*.sbtl")
    good, errors = timelines.decode_packed(files)
    rows = {(r.path.split("/")[-1], r.frame): r for r in good.collect()}
    assert set(rows) == {("a.sbtl", 24), ("a.sbtl", 25), ("v1.sbtl", 2)}
    o = rows["a.sbtl", 24].owners["3"]
    assert (o.name, o.minerals, o.gathered_minerals, o.gathered_gas, o.supply_max) == ("WorkerRush", 50, 8, 4, 10)
    assert o.unit_counts == {"siege_tank_tank": 1, "command_center": 1}
    u = o.units[0]
    assert (u.unit_type, u.category, u.completed, u.morphing_building, u.lifted, u.build_queue_unit_ids) == ("goliath_turret", "subunit", True, True, False, [7])
    v1 = rows["v1.sbtl", 2].owners["4"]
    assert (v1.gathered_minerals, v1.supply_current, v1.supply_max, v1.workers_alive) == (None, 3, 9, 5)
    assert {r.path.split("/")[-1] for r in errors.collect()} == {"cut.sbtl", "bad.sbtl"}
    named = timelines.with_match_id(good, files)
    series = reduction.reduce_timeline(named.where("frame = 24"))
    counts = series["unit_counts"].first()
    assert counts.counts == {"siege_tank": 1, "command_center": 1} and len(counts.replay_id) == 64
    assert series["deaths"].count() == 0


def test_jsonl_and_format(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('﻿{"frame": 1, "owners": {"3": {"minerals": 1, "gas": 2}}}\n\n{"frame": 2\n{"frame": 3, "owners": {}, "deaths": []}\n')
    good, bad = timelines.read_jsonl(spark, str(tmp_path))
    assert sorted(r.frame for r in good.collect()) == [1, 3] and bad.count() == 1
    heads = spark.createDataFrame([("a.SBTL", b"{"), ("b.jsonl", b"\x95"), ("c", b"\xef\xbb\xbf \n{"), ("d", b"\x95\x00")], "path string, head binary")
    got = {r.path: r.f for r in heads.select("path", timelines.format_of(F.col("path"), F.col("head")).alias("f")).collect()}
    assert got == {"a.SBTL": "packed", "b.jsonl": "jsonl", "c": "jsonl", "d": "packed"}


def test_listings(spark, tmp_path):
    for name, text in (("x/A.rep", b"1"), ("y/b.REP", b"1"), ("y/c.rep", b"2"), ("y/d.txt", b"3")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text)
    files = inventory.match_files(timelines.read_files(spark, str(tmp_path)))
    assert sorted(r.copies for r in files.collect()) == [1, 2]
    assert inventory.list_files(spark, str(tmp_path), "*.txt").count() == 1
    (tmp_path / "cat.csv").write_text("name,race,type,buildTime,mineralCost,gasCost,supplyCost,builtFrom\nSCV,Terran,Unit,12.6,50,0,1,Command Center\n")
    assert inventory.read_catalog(spark, str(tmp_path / "cat.csv")).first().buildTime == 12.6
    names = spark.createDataFrame([("a", "x.html"), ("b", "x.html"), ("c", "y.html")], "replay_id string, html_name string")
    assert {r.replay_id: r.zip_path for r in inventory.archive_names(names).collect()} == {
        "a": "replays/x.html", "b": "replays/b-2-x.html", "c": "replays/y.html"}


def test_reports_and_backfill(spark, tmp_path):
    import base64

    write_bundle(tmp_path / "player_3.zip", 3, "pbjt", "zerg", ["00:10 Drone"], economy=[eco(1.0), eco(2.1)])
    write_bundle(tmp_path / "aaa.zip", 3, "other", "zerg", ["00:10 Drone"])
    write_bundle(tmp_path / "named.zip", 1, "Scan", "terran", ["00:10 SCV"], economy=[eco(4.2)])
    packed = base64.b64encode((tmp_path / "player_3.zip").read_bytes()).decode()
    html = f'<script>x</script><script class="embedded-build-order-dataset" data-name="pb" type="t">\n{packed}\n</script><script class="embedded-build-order-dataset" data-name="bad">%%%</script>'
    pages = spark.createDataFrame([("p1", html), ("p2", "<p>")], "path string, html string")
    got = inventory.report_datasets(pages).collect()
    assert {r.member for r in got if r["name"] == "pb"} == {"player.json", "build_order.txt", "economy.json", "supply.json"}
    assert [r.problem is not None for r in got if r["name"] == "bad"] == [True]
    files = timelines.read_files(spark, str(tmp_path), "*.zip").select(
        F.lit("/out/m").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content")
    m = inventory.backfill_manifests(files).first()
    assert [(p.owner, p.name, p.zip_filename) for p in m.players] == [(1, "Scan", "named.zip"), (3, "pbjt", "player_3.zip")]
    assert m.matchup == "TvZ" and m.duration_seconds == 4.2 and len(m.replay_id) == 64


def test_archives_are_opened_once(spark, tmp_path, monkeypatch):
    """However many tables follow, a full ingest expands the archives in one place."""
    write_match(tmp_path / "in", "a", "m1", [player(1, "x", "zerg", ["00:10 Drone"])])
    opened = []
    inner = bundles.expand_archives
    monkeypatch.setattr(bundles, "expand_archives", lambda *a, **k: opened.append(1) or inner(*a, **k))
    manifests = bundles.latest_manifests(bundles.read_manifests(spark, str(tmp_path / "in")).good)
    tables, errors = bundles.read_matches(spark, manifests, str(tmp_path / "in"))
    assert opened == [1] and errors.count() == 0 and len(tables) == 7
    for df in tables.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "binaryFile" not in plan


def test_lines(spark):
    texts = ["06:00 [58/66] Mutalisk", "  1:09  Science   Vessel ", "00:10 [58/66]", "00:10 [5x/6] A b", "00:10 Drone\r", "7:60 A", "00:10", "x00:10 A", "00:10[1/2] A", "00:10 A\u2028B"]
    rows = spark.createDataFrame([("m", 1, "z", i, t) for i, t in enumerate(texts)], "replay_id string, owner int, zip_path string, event_seq int, raw_line string")
    good, bad = bundles.parse_line_rows(rows)
    got = [(r.time_seconds, r.supply_used, r.supply_max, r.item) for r in good.orderBy("event_seq").collect()]
    assert got == [(360.0, 58, 66, "Mutalisk"), (69.0, None, None, "Science   Vessel"), (10.0, None, None, "[58/66]"), (10.0, None, None, "[5x/6] A b"), (10.0, None, None, "Drone")]
    assert bad.count() == 5


def test_library_and_artifacts(spark):
    manifests = spark.createDataFrame([("/d/a/manifest.json", "a"), ("/d/b/manifest.json", "b"), ("/d/c/manifest.json", "a"), ("/d/e/manifest.json", None)], "manifest_path string, replay_id string")
    listing = spark.createDataFrame([("/d/a/a.html",), ("/d/a/z.html",), ("/d/b/q.html",), ("/d/b/r.html",)], "path string")
    found, warnings = inventory.report_artifacts(manifests, listing)
    assert [(r.replay_id, r.html_path) for r in found.collect()] == [("a", "/d/a/a.html")]
    assert {(r.kind, r.replay_id) for r in warnings.collect()} == {("invalid_manifest", None), ("duplicate_replay_id", "a"), ("ambiguous_html", "b")}
    wanted = spark.createDataFrame([("a",), ("zz",)], "replay_id string")
    assert [r.replay_id for r in inventory.missing_artifacts(wanted, found).collect()] == ["zz"]


def test_csv_quoting(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "hi", x', None, {"k": 1})], "id string, t string, n int, m map<string,int>")
    sinks.write_csv(rows, str(tmp_path / "c"))
    text = max((p.read_text() for p in (tmp_path / "c").glob("part*")), key=len).splitlines()
    assert text == ['"id","t","n","m"', '"a","say ""hi"", x","","{""k"":1}"']


def test_bundles_written(spark, tmp_path):
    raw = spark.read.schema("replay_id string, frame int, owners map<string,struct<name:string,minerals:int,gas:int,gathered_minerals:int,gathered_gas:int,workers_alive:int,supply_current:int,supply_max:int,unit_counts:map<string,int>,units:array<struct<id:int,unit_type:string,unit_type_id:int,category:string,build_queue_unit_ids:array<int>,upgrade_in_progress:int,tech_in_progress:int,morphing_building:boolean,morph_target_unit_type_id:int,build_time:int,remaining_build_time:int>>>>, deaths array<struct<id:int,owner:int,unit_type:string,unit_type_id:int,category:string,pos_x:int,pos_y:int>>").json(
        spark.sparkContext.parallelize([json.dumps({"replay_id": "m", "frame": f, "owners": {"3": {"minerals": 5, "gas": f, "supply_current": 4, "supply_max": 9, "unit_counts": {"drone": 4}, "units": []}}, "deaths": []}) for f in (2, 0, 1)])
    )
    series = reduction.reduce_timeline(staging.stage(raw))
    sinks.write_bundles(series, str(tmp_path / "out"))
    doc = json.loads(spark.read.json(str(tmp_path / "out/economy")).first().json)
    assert [s["frame"] for s in doc["samples"]] == [0, 1, 2] and doc["schema_version"].endswith("economy-v1")
    assert len(json.loads(spark.read.json(str(tmp_path / "out/supply")).first().json)["samples"]) == 1


def test_json_line_is_parsed_once(spark):
    from matchlens.sources.timelines import parse_jsonl

    lines = spark.createDataFrame(
        [("a", '{"frame": 1, "owners": {}}'), ("a", "  "), ("a", None), ("a", "{oops")], "path string, text string").repartition(1)
    good, bad = parse_jsonl(lines)
    assert [(r.frame, r.owners, r.deaths) for r in good.collect()] == [(1, {}, [])] and [r.reason for r in bad.collect()] == ["not a JSON snapshot: {oops"]
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_archive_members_come_in_bounded_batches(spark, monkeypatch):
    """However many archives a batch has, members are handed on before they add up; the session's batches are bounded in bytes."""
    monkeypatch.setattr(bundles, "BATCH_BYTES", 1000)

    class Files:
        schema = spark.createDataFrame([], "zip_path string, content binary").schema
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, function, _):
            return function

    def archive(text):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("a", text)
            z.writestr("b", "")
        return buf.getvalue()

    rows = [(f"z{i}", archive(str(i % 10) * 300) if i % 7 else b"broken") for i in range(100)]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    expand = bundles.expand_archives(Files(), ["zip_path"])
    assert int(spark.conf.get(name)) <= 8 << 20
    spark.conf.set(name, before)
    out = list(expand(iter([pd.DataFrame(rows, columns=["zip_path", "content"])])))
    assert max(frame["text"].str.len().sum() for frame in out) <= 1300 and len(out) > 10
    found = pd.concat(out)
    assert found["problem"].notna().sum() == 15 and sorted(found.loc[found["member"] == "a", "text"]) == sorted(str(i % 10) * 300 for i in range(100) if i % 7)
    assert found["zip_path"].nunique() == 100


def test_files_are_listed_and_opened_by_tasks(spark, tmp_path, monkeypatch):
    """No listing of the files goes to the driver, and tasks find and open what Spark's sources would."""
    root = tmp_path / "in"
    for folder, rid in (("a", "m1"), ("b/c/d", "m2"), ("_no", "m3"), ("b/.no", "m4"), ("_k=1", "m5"), ("g h", "m6"), ("é", "m7"), ("_metadata", "m8")):
        write_match(root, folder, rid, [player(1, "x", "zerg", ["00:10 Drone"])])
    named = {"up": "../a/player_1.zip", "under": "e/f.zip", "dot": "./p.zip", "hid": "_p.zip", "hid2": "_e/p.zip", "copy": "p.zip._COPYING_",
             "kind": "p.txt", "none": "q.zip", "empty": "r.zip", "folder": "s.zip", "double": "e//f.zip", "root": "/p.zip"}
    for rid, name in named.items():
        d = write_match(root, rid, rid, [player(1, "x", "zerg", ["00:10 Drone"])])
        (d / "manifest.json").write_text((d / "manifest.json").read_text().replace("player_1.zip", name))
        for at in ("e", "_e", "s.zip"):
            (d / at).mkdir()
        for at in ("e/f.zip", "p.zip", "_p.zip", "_e/p.zip", "p.zip._COPYING_", "p.txt"):
            (d / at).write_bytes((d / "player_1.zip").read_bytes())
        (d / "r.zip").write_bytes(b"")
    (root / "void").mkdir()
    (root / "void/manifest.json").write_bytes(b"")
    (root / "text").mkdir()
    (root / "text/manifest.json").write_bytes(b"\xff{nope")

    def seen(at):
        texts = bundles.manifest_texts(spark, at)
        found = bundles.parse_manifests(texts)
        manifests = bundles.latest_manifests(found.good)
        members, wanted = bundles.open_archives(spark, manifests, at)
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (texts, members)]
        return plans, sorted(map(tuple, texts.collect())), {tuple(r) for r in members.collect()}, {r.path for r in found.errors.collect()}

    for at in (str(root), f"{root}/", f"file://{root}", f"{root}/[a-b]*"):
        plans, *own = seen(at)
        assert " parquet" in plans[0] and "binaryFile" not in plans[1]
        with monkeypatch.context() as m:
            m.setattr(bundles.files, "reachable", lambda *_: False)
            plans, *theirs = seen(at)
        assert "binaryFile" in plans[1] and own == theirs
    assert len(own[0]) == 2 and {m[0] for m in own[1]} == {"m1", "m2"}
    assert not bundles.files.reachable(["viewfs://store/in"]) and not bundles.files.reachable([])
