"""Exact token counts for every context limit from one length histogram.

Documents are counted by encoded length; suffix sums over the lengths then give,
for each length taken as the limit, how many documents and tokens lie beyond it,
the total after truncation and the share of documents that fit. Sums run within
blocks of 1,024 lengths and over the blocks, so no task holds all lengths.

Edge cases: null and empty text has length 0. Repeated rows count as often as
they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, tidy, tokenizer_path
from .tokens import encoder

BLOCK = 1024


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens for every row."""
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def mapped(batches):
        enc = encoder(path)
        for b in batches:
            n = np.fromiter(map(len, enc.encode_all(b.column("text").to_pylist())), dtype=np.int64, count=b.num_rows) // 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(mapped), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length and n_docs; counted in the tasks first, so a length that most rows share is no burden."""
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """`counts` (length, n_docs) with totals for each length as the context limit."""
    counts = stage(counts, "lengths")  # read twice below; the texts are encoded once
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # over blocks: few rows
    zero = F.lit(0).cast("long")
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("docs").over(after), zero).alias("docs_after"), F.coalesce(F.sum("tokens").over(after), zero).alias("tokens_after"),
        F.sum("docs").over(everything).alias("all_docs"), F.sum("tokens").over(everything).alias("total_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        F.col("length").alias("context_limit"), "n_docs",
        (F.coalesce(F.sum("n_docs").over(longer), zero) + F.col("docs_after")).alias("docs_longer"),
        (F.coalesce(F.sum("n_tokens").over(longer), zero) + F.col("tokens_after")).alias("tokens_in_longer"),
        "all_docs", "total_tokens",
    )
    return out.select(
        "context_limit", "n_docs", "docs_longer", "tokens_in_longer", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_in_longer") + F.col("context_limit") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )
