"""Queries that run a stream over the tables to completion and read its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from ..streaming import jobs, late
from .adapters import LAYOUTS, Tables
from .registry import query


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream; its wall-clock time read as UTC, as event time needs an instant."""
    rows = t.spark.readStream.schema(LAYOUTS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(t.root)
    return rows.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))


def _wall(*names: str) -> dict:
    back = "timestampadd(MICROSECOND, unix_micros({0}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return {n: F.expr(back.format(n)) for n in names}


def _finish(t: Tables, df: DataFrame, schema: str) -> DataFrame:
    out, checkpoint = staging.new_path(t.spark, "stream"), staging.new_path(t.spark, "checkpoint")
    jobs.run_available(df, out, checkpoint)
    return t.spark.read.schema(schema).parquet(out)


@query(
    sql="""
WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events),
w AS (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS losses FROM events GROUP BY 1, 2)
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, losses FROM w, m WHERE window_start + INTERVAL 1 HOUR <= mark"""
)
def stream_windows(t: Tables) -> DataFrame:
    """Hourly counts per event type; windows still open at the end are not out yet."""
    df = jobs.loss_windows(_stream(t, "events"), ["event_type"], width="1 hour")
    return _finish(t, df, "event_type string, window_start timestamp, window_end timestamp, losses bigint").withColumns(
        _wall("window_start", "window_end")
    )


@query(
    sql="""
WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events),
p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM p)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS losses FROM n, m GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= any_value(mark)"""
)
def stream_sessions(t: Tables) -> DataFrame:
    df = jobs.loss_sessions(_stream(t, "events"), ["user_id"], gap="1 hour")
    return _finish(t, df, "user_id bigint, first_ts timestamp, last_ts timestamp, losses bigint").withColumns(
        _wall("first_ts", "last_ts")
    )


@query(
    sql="""
SELECT user_id, event_id AS frame, CAST(floor(value / 50) AS BIGINT) AS level FROM
 (SELECT *, lag(floor(value / 50)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> floor(value / 50)"""
)
def stream_changes(t: Tables) -> DataFrame:
    rows = _stream(t, "events").select(
        "user_id", F.col("event_id").alias("frame"), F.floor(F.col("value") / 50).alias("level"), "ts"
    )
    df = jobs.changed_values(rows, ["user_id"], "level")
    return _finish(t, df, "user_id bigint, frame bigint, level bigint, late boolean").where(~F.col("late")).drop("late")


# Three runs of one stream: ten days of the month each, and every tenth event held back to the last run.
_STEPS = """
WITH r AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN 2 ELSE least(2, (date_part('day', ts) - 1) // 10) END AS step FROM events),
m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM r WHERE step < 2),
s AS (SELECT r.*, step = 2 AND {end} <= mark AS late FROM r, m)"""


def _in_steps(t: Tables, kind: late.Windows | late.Sessions) -> str:
    """The folder of a run of `kind` over the events in three steps."""
    folder, root, checkpoint = (staging.new_path(t.spark, x) for x in ("events", "late", "checkpoint"))
    micros = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"
    events = t.read("events").select(
        "event_id", "user_id", "event_type", F.expr(micros).alias("ts"),
        F.when(F.col("event_id") % 10 == 3, 2).otherwise(F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))).alias("step"))
    for step in range(3):
        rows = events.where(F.col("step") == step).drop("step")
        rows.write.parquet(f"{folder}/{step}")
        stream = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)
        late.start(stream, kind, root, checkpoint).awaitTermination()
    return root


@query(sql=_STEPS.format(end="date_trunc('hour', ts) + INTERVAL 1 HOUR") + " SELECT event_id, user_id, event_type, CAST(step AS INT) AS batch FROM s WHERE late")
def stream_late_rows(t: Tables) -> DataFrame:
    """Every event that came after its hour had closed."""
    return late.late(t.spark, _in_steps(t, late.Windows(("event_type",), seconds=3600))).drop("ts")


@query(
    sql=_STEPS.format(end="date_trunc('hour', ts) + INTERVAL 1 HOUR") + """,
e AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS final FROM events)
SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late, count(*) AS losses,
 any_value(date_trunc('hour', ts) + INTERVAL 1 HOUR <= final) AS closed
FROM s, e GROUP BY event_type, date_trunc('hour', ts) HAVING count(*) FILTER (NOT late) > 0"""
)
def stream_windows_complete(t: Tables) -> DataFrame:
    """Hourly counts, closed and still open, and the late rows beside them: together what a batch job counts."""
    root = _in_steps(t, late.Windows(("event_type",), seconds=3600))
    counts = late.closed(t.spark, root).withColumn("closed", F.lit(True)).unionByName(late.still_open(t.spark, root).withColumn("closed", F.lit(False)))
    behind = late.late(t.spark, root).groupBy("event_type", F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("late"))
    both = counts.join(behind, ["event_type", "window_start"], "left").withColumn("late", F.coalesce("late", F.lit(0)))
    return both.select(
        "event_type", "window_start", F.col("losses").alias("on_time"), "late", (F.col("losses") + F.col("late")).alias("losses"), "closed"
    ).withColumns(_wall("window_start"))


@query(
    sql=_STEPS.format(end="ts + INTERVAL 1 HOUR") + """,
p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM s WHERE NOT late),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM p)
SELECT user_id, 'session' AS kind, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS losses FROM n GROUP BY user_id, run
UNION ALL SELECT user_id, 'late', ts, ts, count(*) FROM s WHERE late GROUP BY user_id, ts"""
)
def stream_sessions_complete(t: Tables) -> DataFrame:
    """Sessions of rows in time, closed and still open, and the late rows."""
    root = _in_steps(t, late.Sessions(("user_id",), seconds=3600))
    runs = late.closed(t.spark, root).unionByName(late.still_open(t.spark, root)).withColumn("kind", F.lit("session"))
    behind = late.late(t.spark, root).groupBy("user_id", F.col("ts").alias("first_ts")).agg(F.count(F.lit(1)).alias("losses"))
    rows = runs.unionByName(behind.withColumns({"last_ts": F.col("first_ts"), "kind": F.lit("late")}))
    return rows.select("user_id", "kind", "first_ts", "last_ts", "losses").withColumns(_wall("first_ts", "last_ts"))
