"""Corpus-shaped views of the star-schema and event tables, in Spark and in SQL.

`M_SQL` and `T_SQL` are common table expressions with the same definitions, for
checking a query against another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, Corpus, with_folded

DAY0 = "1995-01-01"

TABLE_NAMES = [n for n in TABLES if n != "schema_metadata"]

# Layouts of the input tables, so that no read has to look into a file first.
LAYOUTS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ,"
    " o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


class Tables:
    """Lazy access to the tables of one directory and the views derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(LAYOUTS[name]).parquet(f"{self.root}/{name}.parquet")

    # Events by user.

    @cached_property
    def events(self) -> DataFrame:
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        return self.read("events").select(
            "event_id", "user_id", F.col("event_type").alias("item"), (micros / 1e6).alias("time_seconds"), "value", "ts", "props"
        )

    # Matches from orders and line items.

    @cached_property
    def lines(self) -> DataFrame:
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY0).cast("date")).cast("double")
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("replay_id"),
            F.col("l_suppkey").alias("owner"),
            day.alias("time_seconds"),
            (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("seq"),
            "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )

    @cached_property
    def typed_lines(self) -> DataFrame:
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
        return self.lines.join(part, "l_partkey")

    @cached_property
    def corpus(self) -> Corpus:
        return MatchCorpus(self)

    @cached_property
    def catalog(self) -> DataFrame:
        top = F.max("p_partkey")
        return (
            self.read("part").where(F.col("p_type") != "PROMO").groupBy(F.col("p_type").alias("name")).agg(
                F.lit("Zerg").alias("race"),
                F.when(F.min("p_partkey") % 2 == 0, "Building").otherwise("Unit").alias("type"),
                (top % 7 + 1).cast("double").alias("buildTime"),
                (top % 97).cast("int").alias("mineralCost"),
                (top % 53).cast("int").alias("gasCost"),
                F.lit(1.0).alias("supplyCost"),
                F.lit("Drone").alias("builtFrom"),
            )
        )

    # Snapshot timelines: one match per supplier, one snapshot per ship day.

    @cached_property
    def snapshots(self) -> DataFrame:
        def unit(row):
            p, q = row["p"], row["q"]
            type_id = F.when(q % 4 == 0, F.lit(131) + p % 3).when(q % 4 == 1, F.lit(106) + p % 3).otherwise(F.lit(36) + p % 3)
            return F.struct(
                row["id"].alias("id"),
                F.concat(F.lit("type_"), type_id.cast("string")).alias("unit_type"),
                type_id.cast("int").alias("unit_type_id"),
                F.when(q % 4 < 2, "building").otherwise("unit").alias("category"),
                F.array((F.lit(37) + p % 2).cast("int"), (F.lit(37) + q % 3).cast("int"), (F.lit(132) + q % 2).cast("int")).alias("build_queue_unit_ids"),
                F.when(q % 5 == 0, p % 4).cast("int").alias("upgrade_in_progress"),
                F.when(q % 7 == 0, p % 3).cast("int").alias("tech_in_progress"),
                (q % 3 == 0).alias("morphing_building"),
                F.when(q % 6 == 0, F.lit(133)).cast("int").alias("morph_target_unit_type_id"),
                F.when(q % 2 == 0, F.lit(10)).cast("int").alias("build_time"),
                F.when(q % 4 != 1, q % 12).cast("int").alias("remaining_build_time"),
            )

        def owner(side):
            mq, c = side["mq"], F.size(side["rows"])
            return F.struct(
                F.when(mq % 3 == 0, F.concat(F.lit("name"), side["owner"].cast("string"))).alias("name"),
                F.when(mq < 49, mq).alias("minerals"),
                F.array_min(F.transform(side["rows"], lambda r: r["p"])).alias("gas"),
                F.lit(None).cast("int").alias("gathered_minerals"),
                F.lit(None).cast("int").alias("gathered_gas"),
                c.alias("workers_alive"),
                (mq % 3).cast("int").alias("supply_current"),
                F.lit(9).alias("supply_max"),
                F.map_from_arrays(F.array(F.lit("drone"), F.lit("goliath_turret")), F.array(c, (mq % 2).cast("int"))).alias("unit_counts"),
                F.transform(side["rows"], unit).alias("units"),
            )

        # Lines are dealt by snapshot while they are narrow. A snapshot has two sides of five units at most, so its units
        # are twenty numbers (least part and quantity of each) that one hash aggregate finds, without lists to gather.
        n, p = F.col("l_linenumber"), F.col("l_partkey")
        lines = self.lines.select(
            F.col("owner").alias("replay_id"), F.col("time_seconds").cast("int").alias("frame"), (n % 2 * 5 + p % 5).cast("int").alias("cell"),
            p.cast("int").alias("p"), F.col("l_quantity").cast("int").alias("q")).repartition("replay_id", "frame")
        least = lambda c, i: F.min(F.when(F.col("cell") == i, F.col(c))).alias(f"{c}{i}")
        gathered = lines.groupBy("replay_id", "frame").agg(*[least(c, i) for i in range(10) for c in "pq"])
        rows = lambda o: F.filter(F.array(*[
            F.struct(F.lit(i).alias("id"), F.col(f"p{5 * o + i}").alias("p"), F.col(f"q{5 * o + i}").alias("q")) for i in range(5)]), lambda r: r["p"].isNotNull())
        sides = F.transform(
            F.filter(F.array(*[F.struct(F.lit(o).alias("owner"), rows(o).alias("rows")) for o in (0, 1)]), lambda s: F.size(s["rows"]) > 0),
            lambda s: F.struct(s["owner"], s["rows"], F.array_max(F.transform(s["rows"], lambda r: r["q"])).alias("mq")))
        death = "array<struct<id:int,owner:int,unit_type:string,unit_type_id:int,category:string,pos_x:int,pos_y:int>>"
        return gathered.select("replay_id", "frame", sides.alias("sides")).select(
            "replay_id", "frame",
            F.map_from_entries(F.transform("sides", lambda s: F.struct(s["owner"].cast("string"), owner(s)))).alias("owners"),
            F.array().cast(death).alias("deaths"))


K = ["replay_id", "owner", "time_seconds"]


class MatchCorpus(Corpus):
    """Corpus tables over orders and line items; a table is planned when first used."""

    def __init__(self, t: Tables):
        self._t = t

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        df = with_folded(getattr(self, f"_{name}")(), name)
        self.__dict__[name] = df
        return df

    @property
    def catalog(self) -> DataFrame:
        return self._t.catalog

    def _replays(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self._t.read("orders").select(
            key.alias("replay_id"),
            F.concat(F.lit("game-"), key.cast("string"), F.lit(".rep")).alias("source_replay_filename"),
            F.lit(None).cast("string").alias("source_replay_path"),
            F.col("o_orderpriority").alias("matchup"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("map"),
            (F.col("o_totalprice") / 100).alias("duration_seconds"),
            F.concat(F.lit("m/"), key.cast("string")).alias("manifest_path"),
        )

    def _players(self) -> DataFrame:
        supplier = self._t.read("supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("name"), "s_nationkey")
        nation = self._t.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("race"))
        both = self._t.read("lineitem").select(F.col("l_orderkey").alias("replay_id"), F.col("l_suppkey").alias("owner")).distinct()
        zip_path = F.concat_ws("/", F.lit("z"), F.col("replay_id").cast("string"), F.col("owner").cast("string"))
        return both.join(supplier, "owner").join(nation, "s_nationkey").select(
            "replay_id", "owner", "name", "race", zip_path.alias("zip_path")
        )

    def _build_order_events(self) -> DataFrame:
        return self._t.typed_lines.select(
            *K,
            F.col("l_quantity").cast("int").alias("supply_used"),
            F.lit(50).alias("supply_max"),
            F.col("p_type").alias("item"),
            F.concat_ws("#", "p_type", F.col("l_linenumber").cast("string")).alias("raw_line"),
            F.col("seq").alias("event_seq"),
        )

    def _economy_samples(self) -> DataFrame:
        q = F.col("l_quantity").cast("int")
        return self._t.lines.select(
            *K,
            F.floor("l_extendedprice").alias("minerals"),
            F.floor(F.col("l_tax") * 100 + 0.5).alias("gas"),
            F.col("l_partkey").alias("gathered_minerals"),
            F.lit(None).cast("bigint").alias("gathered_gas"),
            F.when(q < 48, q).alias("workers"),
            F.col("seq").alias("frame"),
        )

    def _supply_samples(self) -> DataFrame:
        top = F.when(F.col("l_tax") == 0, 0).otherwise(40)
        return self._t.lines.select(
            *K, F.col("l_quantity").cast("int").alias("current"), top.alias("max"), F.col("seq").alias("frame")
        )

    def _unit_count_samples(self) -> DataFrame:
        return self._t.typed_lines.select(
            *K, F.col("p_type").alias("unit_type"), F.col("l_quantity").cast("int").alias("count"), F.col("seq").alias("frame")
        )

    def _death_events(self) -> DataFrame:
        n = F.col("l_linenumber")
        category = (
            F.when(n == 1, "worker").when(n == 2, "building").when(n == 3, "air").when(n == 4, "resource").otherwise("unit")
        )
        return self._t.typed_lines.where(F.col("l_returnflag") == "R").select(
            *K, F.col("seq").alias("frame"), F.col("owner").alias("dead_owner"), F.col("p_type").alias("unit_type"),
            category.alias("category"), F.col("seq").alias("death_id"),
        )


M_SQL = f"""
lines AS (
  SELECT l_orderkey AS replay_id, l_suppkey AS owner,
         CAST(date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time_seconds,
         l_partkey * 100 + l_linenumber AS seq,
         l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem),
typed_lines AS (SELECT lines.*, p_type, p_brand FROM lines JOIN part ON p_partkey = l_partkey),
replays AS (
  SELECT o_orderkey AS replay_id, 'game-' || o_orderkey || '.rep' AS source_replay_filename,
         CAST(NULL AS VARCHAR) AS source_replay_path, o_orderpriority AS matchup,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS map,
         o_totalprice / 100 AS duration_seconds, 'm/' || o_orderkey AS manifest_path
  FROM orders),
players AS (
  SELECT d.replay_id, d.owner, s_name AS name, n_name AS race, 'z/' || d.replay_id || '/' || d.owner AS zip_path
  FROM (SELECT DISTINCT l_orderkey AS replay_id, l_suppkey AS owner FROM lineitem) d
  JOIN supplier ON s_suppkey = d.owner JOIN nation ON n_nationkey = s_nationkey),
build_order_events AS (
  SELECT replay_id, owner, time_seconds, CAST(l_quantity AS INT) AS supply_used, 50 AS supply_max, p_type AS item,
         p_type || '#' || l_linenumber AS raw_line, seq AS event_seq FROM typed_lines),
economy_samples AS (
  SELECT replay_id, owner, time_seconds, CAST(floor(l_extendedprice) AS BIGINT) AS minerals,
         CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS gas, l_partkey AS gathered_minerals, CAST(NULL AS BIGINT) AS gathered_gas,
         CASE WHEN l_quantity < 48 THEN CAST(l_quantity AS INT) END AS workers, seq AS frame FROM lines),
supply_samples AS (
  SELECT replay_id, owner, time_seconds, CAST(l_quantity AS INT) AS current,
         CASE WHEN l_tax = 0 THEN 0 ELSE 40 END AS max, seq AS frame FROM lines),
unit_count_samples AS (
  SELECT replay_id, owner, time_seconds, p_type AS unit_type, CAST(l_quantity AS INT) AS count, seq AS frame FROM typed_lines),
death_events AS (
  SELECT replay_id, owner, seq AS frame, time_seconds, owner AS dead_owner, p_type AS unit_type,
         CASE l_linenumber WHEN 1 THEN 'worker' WHEN 2 THEN 'building' WHEN 3 THEN 'air' WHEN 4 THEN 'resource' ELSE 'unit' END AS category,
         seq AS death_id
  FROM typed_lines WHERE l_returnflag = 'R'),
catalog AS (
  SELECT p_type AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN 'Building' ELSE 'Unit' END AS type,
         CAST(max(p_partkey) % 7 + 1 AS DOUBLE) AS build_time, CAST(max(p_partkey) % 97 AS INT) AS minerals,
         CAST(max(p_partkey) % 53 AS INT) AS gas FROM part WHERE p_type <> 'PROMO' GROUP BY p_type),
combat AS (
  SELECT d.*, lower(d.unit_type) AS unit_key,
         CASE category WHEN 'worker' THEN 'workers' WHEN 'building' THEN 'buildings' ELSE 'units' END AS lane,
         coalesce(c.name, upper(substr(d.unit_type, 1, 1)) || lower(substr(d.unit_type, 2))) AS display_name,
         coalesce(c.minerals, 0) AS minerals, coalesce(c.gas, 0) AS gas, c.name IS NOT NULL AS known_cost
  FROM death_events d LEFT JOIN catalog c ON c.name = d.unit_type WHERE category <> 'resource'),
pairs AS (
  SELECT r.replay_id, r.matchup, r.map, s.owner AS self_owner, s.name AS player_name, s.race AS player_race,
         o.owner AS opponent_owner, o.name AS opponent_name, o.race AS opponent_race, r.source_replay_filename, r.duration_seconds
  FROM replays r JOIN players s USING (replay_id) LEFT JOIN players o ON o.replay_id = r.replay_id AND o.owner <> s.owner)
"""

E_SQL = """
ev AS (SELECT event_id, user_id, event_type AS item,
              date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6 AS time_seconds, value, ts, props FROM events)
"""

T_SQL = f"""
lines AS (
  SELECT l_suppkey AS replay_id, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS frame,
         l_linenumber % 2 AS owner, l_partkey % 5 AS id, min(l_partkey) AS p, CAST(min(l_quantity) AS INT) AS q
  FROM lineitem GROUP BY ALL),
units AS (
  SELECT replay_id, frame, owner, id AS unit_id, p, q,
         CASE q % 4 WHEN 0 THEN 131 + p % 3 WHEN 1 THEN 106 + p % 3 ELSE 36 + p % 3 END AS unit_type_id,
         CASE WHEN q % 4 < 2 THEN 'building' ELSE 'unit' END AS category,
         [37 + p % 2, 37 + q % 3, 132 + q % 2] AS queue,
         CASE WHEN q % 5 = 0 THEN p % 4 END AS upgrade, CASE WHEN q % 7 = 0 THEN p % 3 END AS tech,
         q % 3 = 0 AS morphing, CASE WHEN q % 6 = 0 THEN 133 END AS morph,
         CASE WHEN q % 2 = 0 THEN 10 END AS build_time, CASE WHEN q % 4 <> 1 THEN q % 12 END AS remaining,
         dense_rank() OVER (PARTITION BY replay_id ORDER BY frame) AS ordinal
  FROM lines),
owners AS (
  SELECT replay_id, frame, owner, max(q) AS mq, min(p) AS mp, count(*) AS c FROM lines GROUP BY ALL)
"""
