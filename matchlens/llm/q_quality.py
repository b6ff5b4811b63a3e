"""op4: base counts and the verdict by distribution divergence for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .quality import quality


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"))
