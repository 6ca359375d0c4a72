"""Dated stores, cached range runs, model bundles, reject channels, grouped quantiles and cuts of hot groups."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from barloom.catalog.stores import features_as_scores, fragile_gaps, mixed_payloads
from barloom.functions.ordering import column_quantiles
from barloom.operators.selection import top_per_group, year_round_robin
from barloom.plans import tracking as tk
from barloom.plans import training as tr
from barloom.plans.mining import run_user_miner, user_miner
from barloom.plans.ranges import RangeStore, run_range
from barloom.catalog.modeling import GAP_SCHEMA
from barloom.sources import chart, sinks
from barloom.sources.bars import load_bars
from barloom.sources.dated import DatedStore, path_exists
from barloom.sources.universe import dense_dates

D = [dt.date(2020, 1, d) for d in range(1, 8)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "d date, v int")


def days(spark, *at):
    return spark.createDataFrame([(D[i],) for i in at], "d date")


def test_store_reads_what_is_finished(spark, tmp_path):
    store = DatedStore(spark, str(tmp_path / "s"), "d")
    schema = frame(spark, []).schema
    assert store.finished().count() == 0 and store.read(schema).count() == 0
    assert store.pending(days(spark, 0, 1)).count() == 2
    store.add(frame(spark, [(D[0], 1), (D[0], 2), (D[2], 3)]), days(spark, 0, 1, 2))
    assert {(r["d"], r["rows"]) for r in store.finished().collect()} == {(D[0], 2), (D[1], 0), (D[2], 1)}
    assert [r["d"] for r in store.pending(days(spark, 1, 2, 3)).collect()] == [D[3]]
    # rows without a marker, as a broken job leaves them
    frame(spark, [(D[3], 9)]).withColumns({"store_month": F.lit("2020-01"), "store_run": F.lit("0")}).write.mode("append").partitionBy("store_month", "store_run").parquet(store.rows)
    assert sorted(r["v"] for r in store.read(schema).collect()) == [1, 2, 3]
    # a date is replaced by its newest write, also by one without rows
    store.add(frame(spark, [(D[2], 7)]), days(spark, 0, 2))
    assert sorted((r["d"], r["v"]) for r in store.read(schema).collect()) == [(D[2], 7)]
    assert store.read(schema).columns == ["d", "v"]


def test_store_refuses_rows_of_other_dates(spark, tmp_path):
    store = DatedStore(spark, str(tmp_path / "s"), "d")
    with pytest.raises(Exception, match="not to be finished"):
        store.add(frame(spark, [(D[0], 1)]), days(spark, 1))
    assert store.finished().count() == 0


def test_store_reads_wanted_folders_only(spark, tmp_path):
    store = DatedStore(spark, str(tmp_path / "s"), "d")
    store.add(frame(spark, [(d, i) for i, d in enumerate(D)]), days(spark, *range(7)))
    out = store.read(frame(spark, []).schema, days(spark, 2, 4))
    assert sorted(r["v"] for r in out.collect()) == [2, 4]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "(store_month" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d,2020-01-03), LessThanOrEqual(d,2020-01-05)]" in plan


@pytest.fixture(scope="module")
def bars(spark, sf):
    return load_bars(spark, sf).where("trade_date >= '1995-01-01' and trade_date < '1996-06-01'").cache()


def final_rows(df):
    return sorted((str(r["target_date"]), r["ts_code"], r["final_rank"], r["final_score"], r["phase1_seen_dates"]) for r in df.collect())


def test_range_run_computes_what_is_missing(spark, bars, tmp_path):
    one, two = features_as_scores("phase1", "recent_return_5", "breakout_distance_20"), features_as_scores("phase2", "recent_return_10", "breakout_distance_60")
    calls = []

    def counted(df):
        calls.append(df.select("asof_date").distinct().count())
        return one(df)

    args = dict(top_n=3, lookback=4, window=30)
    dates = [str(r["date"]) for r in dense_dates(bars).orderBy("pos").collect()]
    first, middle, last = dates[120], dates[130], dates[140]
    root = str(tmp_path / "range")
    a = run_range(bars, first, middle, counted, two, root, **args)
    assert {r["status"] for r in a.summary.collect()} == {"computed"} and a.final.count() > 0
    before = final_rows(a.final)
    b = run_range(bars, first, last, counted, two, root, **args)
    status = {str(r["target_date"]): r["status"] for r in b.summary.collect()}
    assert [status[d] for d in dates[120:141]] == ["skipped_existing"] * 11 + ["computed"] * 10
    assert calls[0] == 14 and calls[1] == 10  # anchors of the first run, and those after them
    assert before == [r for r in final_rows(b.final) if r[0] <= middle]
    whole = run_range(bars, first, last, one, two, str(tmp_path / "whole"), **args)
    assert final_rows(whole.final) == final_rows(b.final)
    c = run_range(bars, first, last, counted, two, root, **args)
    assert {r["status"] for r in c.summary.collect()} == {"skipped_existing"} and c.anchors.count() == 0 and len(calls) == 3
    assert final_rows(c.final) == final_rows(b.final)
    d = run_range(bars, first, middle, counted, two, root, skip_existing=False, **args)
    assert {r["status"] for r in d.summary.collect()} == {"computed"} and not d.anchors.where("scored").count()
    assert final_rows(d.final) == before
    with pytest.raises(ValueError, match="no target dates"):
        run_range(bars, "1990-01-01", "1990-02-01", one, two, root, **args)


def test_range_run_after_a_broken_one(spark, bars, tmp_path):
    """Stages of a target are there, its final marker is not: the target is computed again, once."""
    one, two = features_as_scores("phase1", "recent_return_5", "breakout_distance_20"), features_as_scores("phase2", "recent_return_10", "breakout_distance_60")
    dates = [str(r["date"]) for r in dense_dates(bars).orderBy("pos").collect()]
    root, args = str(tmp_path / "range"), dict(top_n=3, lookback=3, window=30)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        run_range(bars, dates[200], dates[203], one, broken, root, **args)
    store = RangeStore(spark, root)
    assert store.phase1.finished().count() == 6 and store.final.finished().count() == 0
    out = run_range(bars, dates[200], dates[203], one, two, root, **args)
    assert not out.anchors.where("scored").count()  # phase 1 was kept
    assert out.summary.where("status = 'computed'").count() == 4
    keys = [(r["target_date"], r["ts_code"]) for r in out.final.collect()]
    assert len(keys) == len(set(keys)) > 0


def test_reviewed_phase1_in_a_range(spark, bars, tmp_path):
    one, two = features_as_scores("phase1", "recent_return_5", "breakout_distance_20"), features_as_scores("phase2", "recent_return_10", "breakout_distance_60")
    config = {"midlong_trend": {"enabled": True, "score_col": "phase1_score_mean", "output_score_col": "adjusted_phase1_score"}}
    dates = dense_dates(bars).where("pos in (150, 160)").select(F.col("date").alias("asof_date"))
    cache = tk.phase1_cache(bars, dates, one, 5, window=30, reviewer=config)
    rows = cache.orderBy("anchor_date", "phase1_rank").collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r["anchor_date"], []).append(r["adjusted_phase1_score"])
    assert all(s == sorted(s, reverse=True) for s in by.values())


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", float(rng.gauss(0, 1)) if i % 5 else None, rng.gauss(0, 9) if i % 7 else float("nan"), int(rng.random() < 0.4), "train" if i < 200 else "test", dt.date(2020, 1, 1)) for i in range(300)]
    return spark.createDataFrame(rows, "sample_id string, a double, b double, label int, split string, asof_date date").cache()


def test_reloaded_models_score_alike(spark, table, tmp_path):
    store = tr.ModelStore(str(tmp_path / "m"))
    train = table.where("split = 'train'")
    models = {"logistic": tr.fit(train, ["a", "b"], "lr", impute=True), "xgb": tr.fit(train, ["b", "a"], "xgb", scale=False, maxIter=3)}
    assert store.names() == []
    for name, m in models.items():
        store.save(name, m, threshold=0.4)
    assert store.names() == ["logistic_regression", "xgboost"]
    for name, m in models.items():
        back = store.load(name)
        assert back.columns == m.columns and back.imputed == m.imputed and (back.scaler and back.scaler.stats) == (m.scaler and m.scaler.stats)
        left, right = (dict(x.score(table).select("sample_id", "score").collect()) for x in (m, back))
        assert left == right and len(left) == 300
    out = store.score(table)
    assert {"score_logistic_regression", "pred_logistic_regression", "score_xgboost", "pred_xgboost"} <= set(out.columns)
    assert out.where("pred_xgboost <> cast(score_xgboost >= 0.4 as int)").count() == 0
    store.save("lr", models["xgb"])  # replaced, the scaler with it
    assert store.load("lr").scaler is None
    with pytest.raises(ValueError, match="no stored model lightgbm"):
        store.load("lgbm")
    with pytest.raises(ValueError, match="feature columns missing"):
        store.load("xgb").score(table.drop("a"))


def test_bundle_of_another_format_is_refused(spark, table, tmp_path):
    m = tr.fit(table.where("split = 'train'"), ["a"], "lr")
    m.save(str(tmp_path / "m"))
    spark.createDataFrame([('{"format": 99}',)], "x string").write.mode("overwrite").text(str(tmp_path / "m" / "preparation"))
    with pytest.raises(ValueError, match="format 99"):
        tr.Scored.load(str(tmp_path / "m"))


def test_rejected_payloads(spark, sf):
    df = mixed_payloads(spark, sf)
    parts = chart.split_payloads(df)
    assert parts.good.count() + parts.rejected.count() == df.count()
    assert {r["reason"] for r in parts.rejected.collect()} == {
        "symbol may be delisted", "payload is not the JSON of a chart", "chart payload has no result", "payload is empty", "payload has no chart",
    }
    with pytest.raises(Exception, match="symbol may be delisted|not the JSON|no result|is empty|no chart"):
        chart.daily_prices(df).count()
    odd = spark.createDataFrame([("x", "[1]"), ("y", ""), ("z", '{"chart": {"result": [null]}}'), ("w", '{"chart": {"result": [{"timestamp": ["a"]}]}}')], "symbol string, payload string")
    assert {r["symbol"] for r in chart.split_payloads(odd).rejected.collect()} == {"X", "Y", "Z", "W"}


def test_failing_entities_are_counted(spark, sf):
    bars = load_bars(spark, sf)
    run = run_user_miner(bars, fragile_gaps, GAP_SCHEMA)
    row = run.accounts(bars).first()
    failed = {r["ts_code"] for r in bars.select("ts_code").distinct().collect() if r["ts_code"].endswith("9")}
    assert {r["ts_code"] for r in run.failures.collect()} == failed and row["failed_symbols"] == len(failed) > 0
    assert row["candidates"] == run.rows.count() > 0 and run.rows.columns == [f.name for f in GAP_SCHEMA]
    with pytest.raises(Exception, match="cannot scan"):
        user_miner(bars, fragile_gaps, GAP_SCHEMA).count()


def test_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(5)
    data = {"x": rng.normal(size=997), "one": np.full(997, 3.0), "few": rng.integers(0, 3, 997).astype(float), "gap": np.where(rng.random(997) < 0.5, np.nan, rng.random(997))}
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).withColumn("none", F.lit(None).cast("double")).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["column"]: r for r in column_quantiles(df, [*data, "none"], probs).collect()}
    assert set(got) == set(data)
    for c, v in data.items():
        v = v[~np.isnan(v)]
        assert got[c]["n"] == len(v)
        np.testing.assert_allclose([got[c][f"q{i}"] for i in range(5)], np.quantile(v, probs), rtol=1e-12)
    assert tr.medians(df, ["x", "none"]) == {"x": pytest.approx(np.median(data["x"])), "none": 0.0}


def test_top_of_a_hot_group_is_cut_before_the_shuffle(spark):
    """One group holds nearly all rows; n is beyond what Spark cuts by itself."""
    n = 5000
    df = spark.range(0, 60_000, 1, 12).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("s"), "id")
    order = [F.desc("s"), F.asc("id")]
    got = {(r["g"], r["rank"]): r["id"] for r in top_per_group(df, ["g"], order, n, "rank").collect()}
    want = {}
    for g in ("a", "b"):
        rows = sorted((-r["s"], r["id"]) for r in df.where(F.col("g") == g).collect())[:n]
        want |= {(g, k): i for k, (_, i) in enumerate(rows, 1)}
    assert got == want
    from barloom.operators.selection import _cut_by_partition

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = _cut_by_partition(df, ["g"], order, 100)
    most = cut.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert cut.where("g = 'a'").count() == 12 * 100 and most < 12 * 100  # a share of the hot group per input partition


def test_year_round_robin_with_a_large_limit(spark):
    rows = [(dt.date(2019 + (i % 10 == 0), 1, 1), float(i % 97), f"k{i:05d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "asof_date date, candidate_score double, sample_id string")
    got = [r["sample_id"] for r in year_round_robin(df, 3000, "candidate_score").collect()]
    years = {y: sorted((-s, k) for d, s, k in rows if d.year == y) for y in (2019, 2020)}
    want = [years[y][k][1] for k in range(4000) for y in (2019, 2020) if k < len(years[y])][:3000]
    assert got == want


def test_paths_are_found(spark, tmp_path):
    assert path_exists(spark, str(tmp_path)) and not path_exists(spark, str(tmp_path / "no"))


@pytest.mark.parametrize("key", ["code", "n"])
def test_symbol_folders_are_spark_partitions(spark, tmp_path, key):
    """Names, types and rows as Spark's partitioned writer leaves them; the tasks write, so no job of Hadoop moves files."""
    codes = ["A.B", "x/y:z", "50%", "a=b", "ü \\[q]^", "", None, "B"]
    rows = [(c, i % 3, D[i % 7], float(i) if i % 5 else None, str(i)) for i in range(70) for c in codes]
    df = spark.createDataFrame(rows, "code string, n int, trade_date date, close double, note string")
    df.repartition(key).write.partitionBy(key).parquet(str(tmp_path / "want"))
    target = tmp_path / "got"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # a symbol lies in several batches
    try:
        sinks.write_by_symbol(df, str(target), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    folders = lambda at: sorted(p.name for p in at.iterdir() if p.is_dir())
    assert folders(target) == folders(tmp_path / "want") and (target / "_SUCCESS").exists()
    assert all([f.name for f in d.iterdir()] == ["part-0.parquet"] for d in target.iterdir() if d.is_dir())
    got, want = (spark.read.parquet(str(tmp_path / n)) for n in ("got", "want"))
    assert got.schema == want.schema
    assert got.count() == len(rows) and got.exceptAll(want).count() == 0
    one = spark.read.parquet(str(target / folders(target)[0])).toPandas()
    assert one["trade_date"].is_monotonic_increasing


def test_symbol_folders_come_whole_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([("a", D[0], 1), ("b", D[1], 2)], "ts_code string, trade_date date, v int")
    target = str(tmp_path / "t")
    sinks.write_by_symbol(df, target)
    with pytest.raises(AnalysisException):
        sinks.write_by_symbol(df, target)
    bad = df.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.write_by_symbol(bad, target, overwrite=True)
    assert spark.read.parquet(target).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    # a table may take the place of the one that it is read from
    sinks.write_by_symbol(spark.read.parquet(target).where("v = 2"), target, overwrite=True)
    assert [r["ts_code"] for r in spark.read.parquet(target).collect()] == ["b"]
