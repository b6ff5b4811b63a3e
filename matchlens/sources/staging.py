"""Intermediate tables in the folder the cluster shares.

A staged table cuts lineage and survives the loss of executors. The folder is
`spark.checkpoint.dir` of the session. Where that is unset a temporary folder is
made in local mode only, as in tests; on a cluster it is an error, since a folder
of the driver's machine cannot be read by the executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


#: Bytes of rows that a Python task takes in at a time, and of members or files it hands on at a time.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to about `size` bytes where they are larger or unlimited; a lower setting stays.

    Archives and documents can be large, and a batch is held several times over on its way to Python and back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(name, str(size))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write a DataFrame once and return a scan of what was written, in folders by the values of `by` (few)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
