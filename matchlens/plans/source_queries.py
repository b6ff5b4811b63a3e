"""Queries through the sources, sinks and the SQL surface."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pattern
from ..operators.ordered import ordered_scan
from ..operators.starters import STARTERS
from ..schema import TABLES, Corpus, column_names, open_corpus
from ..sources import bundles, inventory, sinks, snapshots, staging
from ..sql import capped_query
from ..streaming import jobs
from .adapters import Tables
from .event_queries import PLAYER
from .registry import query
from .search_queries import CONSTRAINTS, EVIDENCE, PLAN

K = ["replay_id", "owner"]


def _manifest_texts(t: Tables) -> DataFrame:
    """Manifests of all matches as JSON; one in seven is broken in some way."""
    c = t.corpus
    people = c.players.groupBy("replay_id").agg(
        F.array_sort(
            F.collect_list(F.struct("owner", "name", "race", F.concat(F.lit("player_"), F.col("owner").cast("string"), F.lit(".zip")).alias("zip_filename")))
        ).alias("players")
    )
    rid = F.col("replay_id")
    doc = F.to_json(
        F.struct(
            F.when(rid % 7 == 1, "v0").otherwise("replay-analysis-manifest-v1").alias("schema_version"),
            rid.cast("string").alias("replay_id"),
            F.struct(F.col("source_replay_filename").alias("filename"), F.col("source_replay_path").alias("path")).alias("source"),
            "matchup", "map", "duration_seconds", "players",
        )
    )
    text = F.when(rid % 7 == 2, F.concat(F.lit("{broken"), doc)).otherwise(doc)
    path = F.concat(F.lit("root/"), rid.cast("string"), F.lit("/manifest.json"))
    return c.replays.join(people, "replay_id").select(path.alias("manifest_path"), text.alias("text"))


@query(
    base="m",
    sql="""SELECT CAST(r.replay_id AS VARCHAR) AS replay_id, matchup, map, duration_seconds, count(*) AS player_count FROM replays r JOIN players p USING (replay_id)
WHERE r.replay_id % 7 NOT IN (1, 2) GROUP BY ALL""",
)
def manifest_parse(t: Tables) -> DataFrame:
    good = bundles.parse_manifests(_manifest_texts(t)).good
    return good.select("replay_id", "matchup", "map", "duration_seconds", F.size("players").cast("bigint").alias("player_count"))


@query(
    base="m",
    sql="""SELECT DISTINCT 'root/' || r.replay_id || '/manifest.json' AS path, CASE r.replay_id % 7 WHEN 1 THEN 'unsupported manifest schema v0' ELSE 'malformed manifest' END AS reason
FROM replays r JOIN players p USING (replay_id) WHERE r.replay_id % 7 IN (1, 2)""",
)
def manifest_errors(t: Tables) -> DataFrame:
    return bundles.parse_manifests(_manifest_texts(t)).errors.select("path", "reason")


def _line_rows(t: Tables) -> DataFrame:
    e = t.corpus.build_order_events
    s = F.col("time_seconds").cast("int")
    clock = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    with_supply = F.concat(clock, F.lit(" ["), F.col("supply_used").cast("string"), F.lit("/50] "), "item")
    odd = F.col("event_seq") % 10
    text = F.when(odd == 1, F.concat(F.lit("x"), clock)).when(odd == 2, F.concat(F.lit("  "), clock, F.lit("  "), "item")).otherwise(with_supply)
    return e.select(*K, "event_seq", F.lit("z").alias("zip_path"), text.alias("raw_line"))


@query(
    base="m",
    sql="""SELECT replay_id, owner, event_seq, time_seconds, CASE WHEN event_seq % 10 <> 2 THEN supply_used END AS supply_used, item, lower(item) AS item_lc
FROM build_order_events WHERE event_seq % 10 <> 1""",
)
def build_line_parse(t: Tables) -> DataFrame:
    good, _ = bundles.parse_line_rows(_line_rows(t))
    return good.select(*K, "event_seq", "time_seconds", "supply_used", "item", "item_lc")


@query(base="m", sql="SELECT replay_id, count(*) AS bad_lines FROM build_order_events WHERE event_seq % 10 = 1 GROUP BY ALL")
def build_line_errors(t: Tables) -> DataFrame:
    _, bad = bundles.parse_line_rows(_line_rows(t))
    return bad.groupBy("replay_id").agg(F.count(F.lit(1)).alias("bad_lines"))


CHUNK = 200


def _chunked(t: Tables) -> DataFrame:
    """Lines of a supplier in time order, cut into participants of a fixed number of rows."""
    rows = t.lines.withColumn("uid", F.col("replay_id") * 100_000_000 + F.col("seq"))
    placed = ordered_scan(rows, ["owner"], ["time_seconds", "uid"], {"rn": ("total", F.lit(1).cast("bigint"))})
    return placed.withColumn("chunk", F.floor((F.col("rn") - 1) / CHUNK).cast("int"))


def _archives(t: Tables) -> DataFrame:
    """One archive per chunk, so of bounded size; some lack a member or name another owner."""
    rows = _chunked(t).groupBy(F.col("owner").alias("replay_id"), F.col("chunk").alias("owner")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(
            F.col("time_seconds").cast("int").alias("frame"), "time_seconds", F.floor("l_extendedprice").cast("int").alias("minerals"),
            F.lit(1).alias("gas"), F.col("l_linenumber").alias("workers"))).alias("s")).alias("samples"))).alias("economy"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.floor(F.col("time_seconds") / 60).cast("int").cast("string"), 2, "0"), F.lit(":00 Item")))), "\n").alias("lines"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    owner = -1 if r.replay_id % 11 == 3 else r.owner
                    z.writestr("player.json", '{"schema_version":"x","owner":%d,"name":"n","race":"zerg"}' % owner)
                    z.writestr("build_order.txt", r.lines)
                    z.writestr("economy.json", r.economy)
                    if r.replay_id % 11 != 4:
                        z.writestr("supply.json", '{"samples":[{"frame":1,"time_seconds":0.5,"current":4,"max":9}]}')
                out.append((r.replay_id, r.owner, f"z/{r.replay_id}_{r.owner}.zip", buf.getvalue()))
            yield pd.DataFrame(out, columns=["replay_id", "owner", "zip_path", "content"])

    staging.bounded_batches(t.spark)
    return rows.mapInPandas(pack, "replay_id bigint, owner int, zip_path string, content binary")


def _read_archives(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    archives = _archives(t)
    # Chunks are numbered without gaps, so the number of a supplier's lines tells them all.
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("owner")
    wanted = t.lines.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).select(F.col("owner").alias("replay_id"), chunks).select(
        *K, F.lit("n").alias("name"), F.lit("zerg").alias("race"),
        F.concat(F.lit("z/"), F.col("replay_id").cast("string"), F.lit("_"), F.col("owner").cast("string"), F.lit(".zip")).alias("zip_path"),
    )
    members = staging.stage(bundles.expand_archives(archives, [*K, "zip_path"], (*bundles.REQUIRED, *bundles.OPTIONAL)), "members", ["member"])
    manifests = t.read("supplier").select(F.col("s_suppkey").alias("replay_id"))
    tables, errors = bundles.parse_series(bundles.judge_bundles(members, wanted), manifests)
    errors = staging.stage(errors, "errors")
    return bundles.faultless(tables, errors), errors


def _put_files(files: DataFrame) -> None:
    """Write (path, content) rows as files of the shared folder; a task that runs again writes the same."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if path.startswith("file:/"):
                    path = "/" + path.removeprefix("file:").lstrip("/")
                store, place = fs.FileSystem.from_uri(path)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(put, "n bigint").agg(F.sum("n")).collect()


def _analyses(t: Tables, root: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) of the archives and of the manifests of all suppliers, as files below `root`."""
    archives = staging.stage(_archives(t), "archives")
    name = F.concat(F.lit("player_"), F.col("owner").cast("string"), F.lit(".zip"))
    folder = F.concat(F.lit(f"{root}/"), F.col("replay_id").cast("string"), F.lit("/"))
    people = archives.groupBy("replay_id").agg(
        F.array_sort(F.collect_list(F.struct("owner", F.lit("n").alias("name"), F.lit("zerg").alias("race"), name.alias("zip_filename")))).alias("players")
    )
    text = F.to_json(F.struct(
        F.lit("replay-analysis-manifest-v1").alias("schema_version"), F.col("replay_id").cast("string").alias("replay_id"),
        F.lit("ZvZ").alias("matchup"), "players",
    ))
    manifests = people.select(F.concat(folder, F.lit("manifest.json")).alias("path"), text.cast("binary").alias("content"))
    return archives.select("replay_id", F.concat(folder, name).alias("path"), "content"), manifests


def _ingested(t: Tables) -> tuple[Corpus, dict[str, DataFrame]]:
    """Analyses of all suppliers written as files and taken in twice, and the report of the second time."""
    root, store = staging.new_path(t.spark, "analyses"), staging.new_path(t.spark, "corpus")
    for files in _analyses(t, root):
        _put_files(files.select("path", "content"))
    for _ in range(2):
        report = sinks.ingest(t.spark, root, store, buckets=4)
    return open_corpus(t.spark, store), report


_SERIES_TOTALS = """
WITH c AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY time_seconds, replay_id * 100000000 + seq) - 1) // 200 AS chunk FROM lines),
e AS (SELECT owner AS replay_id, CAST(chunk AS INT) AS owner, count(*) AS samples, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS minerals, CAST(sum(l_linenumber) AS BIGINT) AS workers
 FROM c WHERE owner % 11 NOT IN (3, 4) GROUP BY ALL)
SELECT CAST(replay_id AS VARCHAR) AS replay_id, owner, 'ZvZ' AS matchup, samples, minerals, workers, samples AS events, CAST(1 AS BIGINT) AS supplies FROM e"""


@query(base="m", sql=_SERIES_TOTALS)
def ingest_end_to_end(t: Tables) -> DataFrame:
    """Files in, corpus tables out: every series of every match without a fault, once though taken in twice."""
    c, _ = _ingested(t)
    return _series_totals(c)


def _series_totals(c: Corpus) -> DataFrame:
    economy = c.economy_samples.groupBy(*K).agg(F.count(F.lit(1)).alias("samples"), F.sum("minerals").alias("minerals"), F.sum("workers").alias("workers"))
    events = c.build_order_events.groupBy(*K).agg(F.count(F.lit(1)).alias("events"))
    supplies = c.supply_samples.groupBy(*K).agg(F.count(F.lit(1)).alias("supplies"))
    people = c.players.select(*K).join(c.replays.select("replay_id", "matchup"), "replay_id")
    return people.join(economy, K).join(events, K).join(supplies, K).select(
        *K, "matchup", "samples", F.col("minerals").cast("bigint").alias("minerals"), F.col("workers").cast("bigint").alias("workers"), "events", "supplies"
    )


@query(base="m", sql=_SERIES_TOTALS)
def stream_ingest(t: Tables) -> DataFrame:
    """All manifests first, archives after them in two parts: the stream takes a match in when its last archive is there."""
    root, store, mark = (staging.new_path(t.spark, x) for x in ("analyses", "corpus", "checkpoint"))
    archives, manifests = _analyses(t, root)
    last = F.pmod(F.hash("path"), F.lit(2)) == 1
    for files in (manifests, archives.where(~last), archives.where(last)):
        _put_files(files.select("path", "content"))
        jobs.ingest_stream(t.spark, root, store, mark, buckets=4).awaitTermination()
    return _series_totals(open_corpus(t.spark, store))


def _as_stored(t: Tables) -> dict[str, DataFrame]:
    """The corpus tables with the types that are stored."""
    out = {}
    for name, df in t.corpus.tables().items():
        layout = [part.split() for part in TABLES[name].split(",")]
        out[name] = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in layout])
    return out


@query(
    base="m",
    sql="""
WITH e AS (SELECT replay_id, count(*) AS all_events, count(*) FILTER (event_seq % 2 = 0) AS even_events FROM build_order_events GROUP BY ALL),
s AS (SELECT replay_id, count(*) AS samples FROM economy_samples GROUP BY ALL),
m AS (SELECT replay_id, matchup, coalesce(all_events, 0) AS all_events, coalesce(even_events, 0) AS even_events, coalesce(samples, 0) AS samples
 FROM replays LEFT JOIN e USING (replay_id) LEFT JOIN s USING (replay_id))
SELECT 'failed' AS after, CAST(replay_id AS VARCHAR) AS replay_id, matchup, all_events AS events, samples FROM m
UNION ALL
SELECT 'committed', CAST(replay_id AS VARCHAR), CASE WHEN replay_id % 4 = 0 THEN 'again' ELSE matchup END,
 CASE WHEN replay_id % 4 = 0 THEN even_events ELSE all_events END, CASE WHEN replay_id % 4 = 0 THEN 0 ELSE samples END FROM m""",
)
def ingest_atomic(t: Tables) -> DataFrame:
    """A quarter of the matches replaced in all tables: once with a failure between tables, which readers must not see, then whole."""
    root = staging.new_path(t.spark, "corpus")
    tables = _as_stored(t)
    snapshots.commit(tables, root)
    chosen = F.col("replay_id").cast("bigint") % 4 == 0
    changed = {n: df.where(chosen) for n, df in tables.items()}
    changed["replays"] = changed["replays"].withColumn("matchup", F.lit("again"))
    changed["build_order_events"] = changed["build_order_events"].where("event_seq % 2 = 0")
    changed["economy_samples"] = changed["economy_samples"].limit(0)
    fails = changed["supply_samples"].withColumn("current", F.raise_error(F.lit("forced failure")).cast("int"))
    states = []
    for after, incoming in (("failed", {**changed, "supply_samples": fails}), ("committed", changed)):
        try:
            snapshots.commit(incoming, root)
        except Exception as error:
            if after != "failed" or "forced failure" not in str(error):
                raise
        c = open_corpus(t.spark, root)
        events = c.build_order_events.groupBy("replay_id").agg(F.count(F.lit(1)).alias("events"))
        samples = c.economy_samples.groupBy("replay_id").agg(F.count(F.lit(1)).alias("samples"))
        states.append(c.replays.join(events, "replay_id", "left").join(samples, "replay_id", "left").select(
            F.lit(after).alias("after"), "replay_id", "matchup", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("samples", F.lit(0)).alias("samples")))
    return states[0].unionByName(states[1])


@query(
    base="m",
    sql="""
WITH c AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY time_seconds, replay_id * 100000000 + seq) - 1) // 200 AS chunk FROM lines)
SELECT owner AS replay_id, CAST(chunk AS INT) AS owner, CAST(time_seconds AS BIGINT) AS frame, CAST(floor(l_extendedprice) AS INT) AS minerals, l_linenumber AS workers
FROM c WHERE owner % 11 NOT IN (3, 4)""",
)
def archive_series(t: Tables) -> DataFrame:
    tables, _ = _read_archives(t)
    return tables["economy_samples"].select(*K, "frame", "minerals", "workers")


@query(
    base="m",
    sql="""
WITH c AS (SELECT *, (row_number() OVER (PARTITION BY owner ORDER BY time_seconds, replay_id * 100000000 + seq) - 1) // 200 AS chunk FROM lines)
SELECT DISTINCT owner AS replay_id, 'z/' || owner || '_' || chunk || '.zip' AS path,
 CASE owner % 11 WHEN 4 THEN 'missing required bundle file supply.json' ELSE 'player.json owner -1 does not match manifest owner ' || chunk END AS reason
FROM c WHERE owner % 11 IN (3, 4)""",
)
def archive_errors(t: Tables) -> DataFrame:
    _, errors = _read_archives(t)
    return errors.select("replay_id", "path", "reason")


@query(sql="SELECT sha256(text) AS replay_id, min('f/' || doc_id || '.REP') AS path, count(*) AS copies FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1")
def match_file_inventory(t: Tables) -> DataFrame:
    """Documents as files: two thirds of them with the wanted suffix."""
    suffix = F.when(F.col("doc_id") % 3 != 0, ".REP").otherwise(".txt")
    files = t.read("documents").select(
        F.concat(F.lit("f/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.col("text").cast("binary").alias("content")
    )
    return inventory.match_files(files)


@query(sql="SELECT page_id AS path, url AS title FROM pages")
def report_titles(t: Tables) -> DataFrame:
    """A title block placed at the end of every page and found among its other scripts."""
    block = F.concat(F.lit('<SCRIPT type="x" class="a embedded-build-order-page-meta">{"title":"'), "url", F.lit('"}</SCRIPT>'))
    pages = t.read("pages").select(F.col("page_id").alias("path"), F.concat("html", block).alias("html"))
    return inventory.report_titles(pages)


@query(
    base="m",
    sql="""
WITH m AS (SELECT 'd/' || o_orderkey || '/manifest.json' AS manifest_path, CAST(CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS replay_id, o_orderkey AS k FROM orders),
f AS (SELECT replay_id, min(manifest_path) AS first_path FROM m GROUP BY ALL)
SELECT m.replay_id, m.manifest_path, CASE WHEN k % 3 = 0 THEN 'd/' || k || '/' || k || '.html' ELSE 'd/' || k || '/a.html' END AS html_path
FROM m JOIN f ON f.replay_id = m.replay_id AND f.first_path = m.manifest_path WHERE k % 3 <> 2""",
)
def report_artifacts(t: Tables) -> DataFrame:
    manifests, listing = _artifact_inputs(t)
    return inventory.report_artifacts(manifests, listing)[0]


@query(
    base="m",
    sql="""
WITH m AS (SELECT 'd/' || o_orderkey || '/manifest.json' AS manifest_path, CAST(CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS replay_id, o_orderkey AS k FROM orders),
f AS (SELECT replay_id, min(manifest_path) AS first_path FROM m GROUP BY ALL)
SELECT CASE WHEN m.manifest_path <> f.first_path THEN 'duplicate_replay_id' ELSE 'ambiguous_html' END AS kind, m.replay_id, m.manifest_path
FROM m JOIN f USING (replay_id) WHERE m.manifest_path <> f.first_path OR k % 3 = 2""",
)
def report_warnings(t: Tables) -> DataFrame:
    manifests, listing = _artifact_inputs(t)
    return inventory.report_artifacts(manifests, listing)[1].select("kind", "replay_id", "manifest_path")


def _artifact_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    folder = F.concat(F.lit("d/"), k.cast("string"))
    orders = t.read("orders")
    manifests = orders.select(
        F.concat(folder, F.lit("/manifest.json")).alias("manifest_path"),
        F.when(k % 10 == 9, k - 1).otherwise(k).cast("string").alias("replay_id"),
    )
    exact = F.concat(folder, F.lit("/"), k.cast("string"), F.lit(".html"))
    names = F.when(k % 3 == 0, F.array(F.concat(folder, F.lit("/a.html")), exact)).when(
        k % 3 == 1, F.array(F.concat(folder, F.lit("/a.html")))
    ).otherwise(F.array(F.concat(folder, F.lit("/a.html")), F.concat(folder, F.lit("/b.HTML"))))
    return manifests, orders.select(F.explode(names).alias("path"))


@query(
    base="m",
    sql="""SELECT CAST(replay_id AS VARCHAR) AS replay_id, source_replay_filename AS filename,
 concat_ws('; ', CASE WHEN replay_id % 4 = 1 THEN 'malformed or missing manifest' END, CASE WHEN replay_id % 4 = 2 THEN 'manifest replay_id does not match the corpus index' END,
  CASE WHEN replay_id % 5 = 0 THEN 'missing report' END) AS warnings FROM replays""",
)
def library_listing(t: Tables) -> DataFrame:
    r = t.corpus.replays.select(
        F.col("replay_id").alias("k"), F.col("replay_id").cast("string").alias("replay_id"),
        F.col("source_replay_filename").alias("filename"), "manifest_path",
    ).withColumn("report_path", F.concat(F.lit("r/"), F.col("replay_id")))
    manifests = r.where(F.col("k") % 4 != 1).select("manifest_path", F.when(F.col("k") % 4 == 2, "other").otherwise(F.col("replay_id")).alias("replay_id"))
    listing = r.where(F.col("k") % 5 != 0).select(F.col("report_path").alias("path"))
    out = inventory.library(r.drop("k"), manifests, listing)
    return out.select("replay_id", "filename", F.array_join("warnings", "; ").alias("warnings"))


@query(
    base="m",
    sql="""SELECT CAST(ceil(rn / 10.0) AS BIGINT) AS batch_number, count(*) AS manifest_count, max(rn) AS manifests_completed, max(n) - max(rn) AS manifests_remaining
FROM (SELECT row_number() OVER (ORDER BY manifest_path) AS rn, count(*) OVER () AS n FROM replays) GROUP BY 1""",
)
def ingest_batches(t: Tables) -> DataFrame:
    return sinks.batch_report(t.corpus.replays).drop("replay_ids")


@query(
    base="m",
    sql="""
SELECT replay_id, count(*) AS rows_, sum(CASE WHEN replay_id % 4 = 0 THEN 1000 ELSE 0 END + CAST(l_quantity AS BIGINT)) AS total FROM lines WHERE NOT (replay_id % 4 = 0 AND l_linenumber = 1) GROUP BY replay_id""",
)
def replace_by_key(t: Tables) -> DataFrame:
    """Write all matches, then replace a quarter of them with changed rows; twice."""
    rows = t.lines.select("replay_id", "owner", "time_seconds", F.col("l_quantity").cast("bigint").alias("q"), "l_linenumber")
    path = staging.new_path(t.spark, "replace")
    sinks.replace_matches(rows, path, rows.select("replay_id"), buckets=8)
    changed = rows.where((F.col("replay_id") % 4 == 0) & (F.col("l_linenumber") != 1)).withColumn("q", F.col("q") + 1000)
    ids = rows.where(F.col("replay_id") % 4 == 0).select("replay_id")
    for _ in range(2):
        sinks.replace_matches(changed, path, ids, buckets=8)
    stored = t.spark.read.schema("replay_id bigint, owner bigint, time_seconds double, q bigint, l_linenumber int").parquet(path)
    return stored.groupBy("replay_id").agg(F.count(F.lit(1)).alias("rows_"), F.sum("q").alias("total"))


@query(
    base="m",
    sql="""
WITH e AS (SELECT replay_id, count(*) AS events FROM build_order_events GROUP BY ALL), d AS (SELECT replay_id, count(*) AS deaths FROM death_events GROUP BY ALL)
SELECT CAST(r.replay_id AS VARCHAR) AS replay_id, matchup, events, coalesce(deaths, 0) AS deaths FROM replays r JOIN e USING (replay_id) LEFT JOIN d USING (replay_id)""",
)
def corpus_roundtrip(t: Tables) -> DataFrame:
    """The whole corpus written as bucketed tables, opened again and joined."""
    path = staging.new_path(t.spark, "corpus")
    tables = {}
    for name, df in t.corpus.tables().items():
        layout = [part.split() for part in TABLES[name].split(",")]
        tables[name] = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in layout])
        assert tables[name].columns == column_names(TABLES[name])
    sinks.write_tables(tables, path, buckets=4)
    c = open_corpus(t.spark, path)
    events = c.build_order_events.groupBy("replay_id").agg(F.count(F.lit(1)).alias("events"))
    deaths = c.death_events.groupBy("replay_id").agg(F.count(F.lit(1)).alias("deaths"))
    return c.replays.join(events, "replay_id").join(deaths, "replay_id", "left").select(
        "replay_id", "matchup", "events", F.coalesce("deaths", F.lit(0)).alias("deaths")
    )


@query(
    base="m",
    sql="""SELECT replay_id, owner, count(*) AS samples, min(time_seconds) AS t0, max(time_seconds) AS t1, CAST(sum(workers) AS BIGINT) AS workers FROM economy_samples GROUP BY ALL""",
)
def series_documents(t: Tables) -> DataFrame:
    """Economy series as JSON documents per participant, read back."""
    docs = sinks.series_documents(
        t.corpus.economy_samples, K, ["frame", "time_seconds", "minerals", "workers"], "replay-analysis-economy-v1", slice_seconds=600
    )
    doc = F.from_json("json", "samples array<struct<frame:bigint,time_seconds:double,minerals:bigint,workers:int>>")
    rows = docs.select(*K, F.explode(doc["samples"]).alias("s"))
    return rows.groupBy(*K).agg(
        F.count(F.lit(1)).alias("samples"), F.min("s.time_seconds").alias("t0"), F.max("s.time_seconds").alias("t1"), F.sum("s.workers").alias("workers")
    )


@query(
    base="m",
    sql=PLAN + """
SELECT replay_id, matchup, t_eco AS first_economy_seconds, lpad(CAST(CAST(floor(t_eco / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(t_eco AS BIGINT) % 60 AS VARCHAR), 2, '0') AS first_economy_clock,
 minerals, large_count, enemy_losses FROM judged WHERE c_early_economy AND c_late_promo AND c_workers AND c_few_losses""",
)
def csv_export_projection(t: Tables) -> DataFrame:
    """Pattern search flattened for export, written as CSV and read back."""
    from ..functions.text import padded_clock

    out = pattern.pattern_search(t.corpus, player=PLAYER, constraints=CONSTRAINTS, evidence=EVIDENCE)
    flat = sinks.export_rows(
        out,
        {
            "first_economy_seconds": ["e_missing.time_seconds", "v_early_economy.time_seconds"],
            "minerals": ["e_eco.minerals", "v_workers.minerals"],
            "large_count": ["e_large.count"],
            "enemy_losses": ["e_losses.total_count"],
        },
    ).withColumn("first_economy_clock", padded_clock("first_economy_seconds"))
    path = staging.new_path(t.spark, "export")
    sinks.write_csv(flat, path)
    back = t.spark.read.schema(", ".join(f"{c} string" for c in flat.columns)).option("header", True).option("escape", '"').csv(path)
    return back.select(
        F.col("replay_id").cast("bigint").alias("replay_id"), "matchup", F.col("first_economy_seconds").cast("double").alias("first_economy_seconds"),
        "first_economy_clock", F.col("minerals").cast("bigint").alias("minerals"), F.col("large_count").cast("int").alias("large_count"),
        F.col("enemy_losses").cast("bigint").alias("enemy_losses"),
    )


@query(
    base="m",
    sql="""SELECT replay_id, matchup, string_agg(owner || ':' || name, ',' ORDER BY owner) AS players, upper(substr(any_value(first_race), 1, 1)) AS first_initial
FROM (SELECT p.*, r.matchup, first(race) OVER (PARTITION BY replay_id ORDER BY owner) AS first_race FROM players p JOIN replays r USING (replay_id)) GROUP BY ALL""",
)
def match_manifests(t: Tables) -> DataFrame:
    c = t.corpus
    frames = c.economy_samples.groupBy("replay_id").agg(F.max("time_seconds").alias("last_frame"))
    src = c.replays.select("replay_id", F.col("source_replay_filename").alias("filename"), F.col("source_replay_path").alias("path"))
    docs = sinks.match_manifests(c.players.select(*K, "name", "race"), frames, src)
    d = F.from_json("json", "matchup string, players array<struct<owner:bigint,name:string,race:string>>")
    rows = docs.select("replay_id", d.alias("d")).where(F.size("d.players") > 0).join(c.replays.select("replay_id", "matchup"), "replay_id")
    return rows.select(
        "replay_id", "matchup",
        F.array_join(F.transform("d.players", lambda p: F.concat_ws(":", p["owner"].cast("string"), p["name"])), ",").alias("players"),
        F.substring("d.matchup", 1, 1).alias("first_initial"),
    )


# Starter reports and the SQL surface.

STARTER_ARGS = {
    "first_occurrence": {"item": "Promo", "race": "Nation_1", "matchup": "1-URGENT"},
    "nth_occurrence": {"item": "large", "n": 1},
    "event_sequence": {"item": "large", "n": 1, "then": "promo"},
    "economy_at": {"at": 900},
    "unit_counts_at": {"at": 900, "units": ("LARGE", "Small")},
    "deaths_window": {"lo": 600, "hi": 1200},
    "card": {"name_part": "GAME-1"},
}

_FIRST_TIMES = """
WITH t AS (
  SELECT replay_id, owner, min(time_seconds) FILTER (lower(item) = 'large') AS large, min(time_seconds) FILTER (lower(item) = 'promo') AS promo
  FROM build_order_events GROUP BY ALL
), w AS (SELECT * FROM players JOIN (SELECT replay_id, source_replay_filename, matchup FROM replays) USING (replay_id))
"""

STARTER_SQL = {
    "players": "SELECT name, race, count(*) AS player_rows FROM players GROUP BY ALL",
    "matchups": "SELECT matchup, count(*) AS replay_count FROM replays GROUP BY ALL",
    "build_items": """SELECT race, item, count(*) AS event_count, count(DISTINCT (replay_id, owner)) AS player_replay_count
FROM build_order_events JOIN players USING (replay_id, owner) GROUP BY ALL""",
    "first_occurrence": _FIRST_TIMES + """SELECT source_replay_filename, matchup, name, race, owner, replay_id, promo AS time_seconds
FROM t JOIN w USING (replay_id, owner) WHERE promo IS NOT NULL AND lower(race) = 'nation_1' AND matchup = '1-URGENT'""",
    "nth_occurrence": _FIRST_TIMES + """SELECT source_replay_filename, name, replay_id, owner, large AS time_seconds
FROM t JOIN w USING (replay_id, owner) WHERE large IS NOT NULL""",
    "event_sequence": _FIRST_TIMES + """SELECT name, source_replay_filename, large AS nth_seconds, promo AS first_seconds, promo - large AS delta_seconds
FROM t JOIN w USING (replay_id, owner) WHERE large < promo""",
    "economy_at": """WITH s AS (
  SELECT replay_id, owner, max_by(struct_pack(t := time_seconds, w := workers, m := minerals, g := gas), (time_seconds, frame)) AS s
  FROM economy_samples WHERE time_seconds <= 900 GROUP BY ALL)
SELECT name, source_replay_filename, s.t AS time_seconds, s.w AS workers, s.m AS minerals, s.g AS gas
FROM s JOIN players USING (replay_id, owner) JOIN replays USING (replay_id)""",
    "unit_counts_at": """WITH s AS (
  SELECT replay_id, owner, unit_type, max_by(struct_pack(c := count), (time_seconds, frame)) AS s
  FROM unit_count_samples WHERE time_seconds <= 900 AND lower(unit_type) IN ('large', 'small') GROUP BY ALL)
SELECT name, source_replay_filename, unit_type, s.c AS count FROM s JOIN players USING (replay_id, owner) JOIN replays USING (replay_id)""",
    "deaths_window": """SELECT name, race, matchup, unit_type, count(*) AS death_count
FROM players JOIN replays USING (replay_id) JOIN (FROM death_events WHERE time_seconds >= 600 AND time_seconds <= 1200) USING (replay_id, owner)
GROUP BY ALL""",
    "card": """SELECT replay_id, source_replay_filename, matchup, map, duration_seconds, owner, name, race
FROM players JOIN replays USING (replay_id) WHERE contains(lower(source_replay_filename), 'game-1')""",
}


def _starter(topic: str) -> None:
    @query(base="m", sql=STARTER_SQL[topic], name=f"curated_{topic}")
    def run(t: Tables) -> DataFrame:
        return STARTERS[topic](t.corpus, **STARTER_ARGS.get(topic, {}))


for _topic in STARTERS:
    _starter(_topic)


@query(
    base="m",
    sql="""SELECT matchup, count(*) AS n, count(*) OVER () > 100 AS truncated FROM replays
WHERE duration_seconds > 500 AND matchup <> '5-LOW' GROUP BY matchup ORDER BY matchup LIMIT 100""",
)
def bounded_sql(t: Tables) -> DataFrame:
    t.corpus.create_views()
    df, cap = capped_query(
        t.spark, "SELECT matchup, count(*) AS n FROM replays WHERE duration_seconds > ? AND matchup <> ? GROUP BY matchup ORDER BY matchup;", [500, "5-LOW"]
    )
    # at most cap + 1 rows reach this window
    return df.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) > cap).limit(cap)


@query(
    base="m",
    sql="""SELECT owner, name, n, true AS truncated FROM (SELECT owner, name, count(*) AS n FROM players GROUP BY owner, name ORDER BY n DESC, owner LIMIT 7)""",
)
def bounded_sql_truncated(t: Tables) -> DataFrame:
    """A statement with more rows than its cap: the first of them, and the flag."""
    t.corpus.create_views()
    text = """WITH who AS (SELECT owner, name, count(*) AS n FROM players GROUP BY owner, name)
SELECT owner, name, n FROM who WHERE n >= ? AND EXISTS (SELECT 1 FROM replays) /* all of them */ ORDER BY n DESC, owner"""
    df, cap = capped_query(t.spark, text, [1], max_rows=7)
    return df.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) > cap).orderBy(F.desc("n"), "owner").limit(cap)
