"""Data-quality reports over corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Corpus
from .scope import K


def orphans(facts: dict[str, DataFrame], players: DataFrame) -> DataFrame:
    """Rows per fact table whose participant does not exist."""
    out = None
    for name, df in facts.items():
        lost = df.select(*K).join(players.select(*K), K, "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))
        row = lost.select(F.lit(name).alias("table_name"), "orphan_rows")
        out = row if out is None else out.unionByName(row)
    return out


def corpus_orphans(corpus: Corpus) -> DataFrame:
    facts = {n: df for n, df in corpus.tables().items() if n not in ("replays", "players")}
    return orphans(facts, corpus.players)


def owner_mismatches(bundles: DataFrame, manifest_players: DataFrame) -> DataFrame:
    """Archives whose own owner differs from the manifest's (replay_id, owner, bundle_owner)."""
    return bundles.join(manifest_players, K).where(F.col("bundle_owner") != F.col("owner"))
