"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file (`public_tokenizers`, else /opt/tokenizers)."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


#: Rows of one Arrow batch. Texts can be long, and a batch is held several times over on its way to Python and back.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows` where it is greater or unlimited; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def exploded_join(exploded: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """An inner join of rows that come from an explode, never by a broadcast.

    Spark sizes an exploded table by the file below it, however many rows it
    makes of a row, and would send one of many times the threshold to the driver.
    """
    return exploded.hint("merge").join(other, on)


def tidy(mapped):
    """A function for mapInArrow that gives a task's memory back to the system at its end; workers live on for other stages."""

    def run(batches):
        try:
            yield from mapped(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
