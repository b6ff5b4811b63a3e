"""The plans of large inputs on small tables: hot keys of 100 rows, distributed summaries, same results as plain SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from matchlens.operators import ordered, quantiles
from matchlens.plans import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import TABLES, canon  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["asof_per_row", "loss_sessions", "supply_compaction", "economy_distribution", "lane_packing"])
def test_large_paths(spark, monkeypatch, name):
    for module in (ordered, quantiles):
        monkeypatch.setattr(module, "is_small", lambda df: False)
    monkeypatch.setattr(ordered, "MAX_ROWS", 100)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    df = QUERIES[name](spark, ROOT)
    cur = con.execute(ORACLES[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])
