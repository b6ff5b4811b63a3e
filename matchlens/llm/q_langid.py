"""op3: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .langid import held_out, identify


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
