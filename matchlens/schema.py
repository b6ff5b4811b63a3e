"""Typed table layouts, column-name records and the corpus container."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from .functions.text import ascii_lower

SCHEMA_VERSION = "1"

MANIFEST = (
    "schema_version string, replay_id string, source struct<filename:string,path:string>, matchup string,"
    " map string, duration_seconds double,"
    " players array<struct<owner:int,name:string,race:string,zip_filename:string>>"
)
MANIFEST_VERSION = "replay-analysis-manifest-v1"

PLAYER_DOC = (
    "schema_version string, owner int, name string, race string, files map<string,string>"
)
ECONOMY_DOC = (
    "samples array<struct<frame:int,time_seconds:double,minerals:int,gas:int,"
    "gathered_minerals:int,gathered_gas:int,workers:int>>"
)
SUPPLY_DOC = ("samples array<struct<frame:int,time_seconds:double,current:int,max:int>>")
COUNTS_DOC = ("samples array<struct<frame:int,time_seconds:double,counts:map<string,int>>>")
DEATHS_DOC = (
    "samples array<struct<frame:int,time_seconds:double,death:struct<id:int,owner:int,unit_type:string,"
    "unit_type_id:int,category:string,pos_x:int,pos_y:int>>>"
)

UNIT = (
    "struct<id:int,unit_type:string,unit_type_id:int,category:string,build_queue_unit_ids:array<int>,"
    "upgrade_in_progress:int,tech_in_progress:int,morphing_building:boolean,morph_target_unit_type_id:int,"
    "build_time:int,remaining_build_time:int>"
)
OWNER = (
    "struct<name:string,minerals:int,gas:int,gathered_minerals:int,gathered_gas:int,workers_alive:int,"
    f"supply_current:int,supply_max:int,unit_counts:map<string,int>,units:array<{UNIT}>>"
)
DEATH = (
    "struct<id:int,owner:int,unit_type:string,unit_type_id:int,category:string,pos_x:int,pos_y:int>"
)
SNAPSHOT = (f"frame int, owners map<string,{OWNER}>, deaths array<{DEATH}>")

CATALOG = (
    "name string, race string, type string, buildTime double, mineralCost int, gasCost int,"
    " supplyCost double, builtFrom string"
)

TABLES = {
    "replays": (
        "replay_id string, source_replay_filename string, source_replay_path string, matchup string, map string,"
        " duration_seconds double, manifest_path string"
    ),
    "players": (
        "replay_id string, owner int, name string, race string, zip_path string, name_lc string, race_lc string"
    ),
    "build_order_events": (
        "replay_id string, owner int, time_seconds double, supply_used int, supply_max int, item string,"
        " raw_line string, event_seq bigint, item_lc string"
    ),
    "economy_samples": (
        "replay_id string, owner int, time_seconds double, minerals int, gas int, gathered_minerals int,"
        " gathered_gas int, workers int, frame bigint"
    ),
    "supply_samples": (
        "replay_id string, owner int, time_seconds double, current int, max int, frame bigint"
    ),
    "unit_count_samples": (
        "replay_id string, owner int, time_seconds double, unit_type string, count int, frame bigint,"
        " unit_type_lc string"
    ),
    "death_events": (
        "replay_id string, owner int, frame bigint, time_seconds double, dead_owner int, unit_type string,"
        " category string"
    ),
    "schema_metadata": ("key string, value string"),
}

def column_names(ddl: str) -> list[str]:
    """Column names of a flat layout, in order."""
    return [part.split()[0] for part in ddl.split(",")]


# Folded copies of the columns that are compared without regard to ASCII case.
FOLDED = {
    "players": {"name": "name_lc", "race": "race_lc"},
    "build_order_events": {"item": "item_lc"},
    "unit_count_samples": {"unit_type": "unit_type_lc"},
}


def with_folded(df: DataFrame, table: str) -> DataFrame:
    """Add the folded columns of a corpus table."""
    for source, target in FOLDED.get(table, {}).items():
        df = df.withColumn(target, ascii_lower(source))
    return df


@dataclass
class Corpus:
    """The fact and dimension tables of one corpus, as DataFrames."""

    replays: DataFrame
    players: DataFrame
    build_order_events: DataFrame
    economy_samples: DataFrame
    supply_samples: DataFrame
    unit_count_samples: DataFrame
    death_events: DataFrame
    catalog: DataFrame | None = field(default=None)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "catalog"}

    def create_views(self) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


def open_corpus(spark: SparkSession, root: str, catalog: DataFrame | None = None, version: int | None = None) -> Corpus:
    """Open a corpus directory: its newest snapshot (or that of a version), or plain
    table folders where it has no snapshots.

    Every table must be there; schemas are the fixed ones, never inferred.
    """
    from .sources import snapshots

    if version is not None or snapshots.versions(spark, root):
        return snapshots.open_snapshot(spark, root, version, catalog)
    reader = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = reader.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.name for f in fields(Corpus) if f.name != "catalog"]
    missing = [n for n in names if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}"))]
    if missing:
        raise ValueError(f"corpus at {root} lacks required tables: {', '.join(missing)}")
    frames = {n: spark.read.schema(TABLES[n]).parquet(f"{root}/{n}").select(*column_names(TABLES[n])) for n in names}
    return Corpus(**frames, catalog=catalog)


