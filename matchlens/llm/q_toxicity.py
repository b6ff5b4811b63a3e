"""op10: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .toxicity import held_out, score


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
