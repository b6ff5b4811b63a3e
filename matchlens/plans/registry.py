"""Registration of named queries with their check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import E_SQL, M_SQL, T_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASES = {"m": M_SQL, "e": E_SQL, "t": T_SQL, None: None}


def query(sql: str | None = None, base: str | None = None, name: str | None = None):
    """Register `fn(tables) -> DataFrame`; `sql` is checked on top of a base view set."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            prefix = BASES[base]
            text = sql.strip()
            if prefix:
                head = f"WITH {prefix.strip()}"
                text = f"{head},\n{text[5:]}" if text[:5].upper() == "WITH " else f"{head}\n{text}"
            ORACLES[key] = text
        return fn

    return wrap


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def long_summary(df: DataFrame, *groups: str) -> DataFrame:
    """Summary with rounded doubles."""
    return df.select(*groups, F.col("n").cast("bigint").alias("n"), *[r6(c).alias(c) for c in ("min", "p25", "median", "p75", "max", "mean")])


SUMMARY_SQL = """
count({v}) AS n, round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS p25,
round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS p75,
round(max({v}), 6) AS max, round(avg({v}), 6) AS mean"""


def summary_sql(value: str) -> str:
    return SUMMARY_SQL.format(v=f"CAST({value} AS DOUBLE)")
