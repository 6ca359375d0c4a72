"""Spark results against the SQL side.  A sample runs by default; BARLOOM_ALL=1 runs every pair."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = [
    "returns", "rolling_mean_std", "winsorize", "local_extrema", "mine_type_n", "mine_range_support_rebound", "mine_w_bottom", "contract_load", "chart_prices",
    "us_export_by_symbol", "upsert_increment", "asof_backward", "asof_forward", "asof_nearest", "asof_global", "history_window", "trading_universe", "anchor_dates",
    "intersect_models", "pullback_samples", "legacy_two_leg", "dataset_build", "tabular_dataset", "phase2_pullback_metrics", "adjust_volume", "price_report",
    "extended_metrics", "rank_ic", "score_summary", "compare_models", "positive_exclusion", "stock_pool", "final_candidates", "walk_forward_members",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = sorted(entry.oracle_sql()) if os.environ.get("BARLOOM_ALL") else SAMPLE


def text(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
