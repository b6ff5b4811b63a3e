"""op6, op7 and op9: packed sequences, token counts and token files of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .packing import pack
from .token_counts import histogram, limits, token_lengths
from .token_files import round_trip


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(histogram(token_lengths(load(spark, sf_dir, "documents"))))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
