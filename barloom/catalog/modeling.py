"""Model training, scoring and scans (MLlib; results differ from other libraries, so no SQL)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.catalog.core import oracle, query
from barloom.catalog.vectors import VEC_SQL
from barloom.catalog.views import samples
from barloom.functions.windows import BARS
from barloom.operators.features import WINDOW_FEATURES
from barloom.operators.splits import date_boundary_split
from barloom.plans import training as tr
from barloom.plans.datasets import build_dataset, scan_features
from barloom.plans.mining import user_miner
from barloom.session import ensure_checkpoint_dir, stored
from barloom.sources.bars import load_bars

SMALL = {"maxIter": 5}
ASOF = "2001-06-30"
TRAIN_END, VALID_END = "1999-12-31", "2000-12-31"


def dataset(spark, sf):
    d = build_dataset(samples(spark, sf).drop("close"), load_bars(spark, sf), 150)
    ensure_checkpoint_dir(spark)
    # training reads the table many times
    return d.withColumn("split", date_boundary_split("asof_date", TRAIN_END, VALID_END)).checkpoint()


def training_rows(spark, sf):
    """Label and features of the training split.  Windows look back only, so no bar after its last date is needed."""
    bars = load_bars(spark, sf, TRAIN_END)
    return stored(build_dataset(samples(spark, sf, bars).drop("close"), bars, 150).select("label", *WINDOW_FEATURES))


@query(
    "standard_scaler",
    oracle(
        "select sample_id, (v.base_range_pct - (select avg(base_range_pct) from vec join samples using (sample_id) where asof_date <= '1999-12-31')) / (select stddev_pop(base_range_pct) from vec join samples using (sample_id) where asof_date <= '1999-12-31') as base_range_pct from vec v",
        VEC_SQL, nums="base_range_pct",
    ),
)
def _scaler(spark, sf):
    d = dataset(spark, sf)
    return tr.Scaler(["base_range_pct"]).fit(d.where("split = 'train'")).transform(d).select("sample_id", "base_range_pct")


@query("train_logistic_predictions")
def _train(spark, sf):
    _, pred, _ = tr.train(dataset(spark, sf), "logistic_regression", maxIter=20)
    return pred.select("sample_id", "y_true", "score")


@query("train_logistic_metrics")
def _train_metrics(spark, sf):
    return tr.train(dataset(spark, sf), "logistic_regression", maxIter=20)[2]


@query("train_many_metrics")
def _many(spark, sf):
    out = tr.train_many(dataset(spark, sf), ["lr", "lightgbm"], lightgbm=SMALL, logistic_regression={"maxIter": 20})
    rows = [m.withColumns({"model": F.lit(n), "split": F.lit(s)}) for n, r in out.items() for s, m in r["metrics"].items() if s != "train"]
    res = rows[0]
    for r in rows[1:]:
        res = res.unionByName(r)
    return res


def pair(spark, sf):
    d = training_rows(spark, sf)
    return tr.fit(d, WINDOW_FEATURES, "lightgbm", scale=False, **SMALL), tr.fit(d, WINDOW_FEATURES, "xgboost", scale=False, **SMALL)


@query("universe_scan")
def _scan(spark, sf):
    from barloom.catalog.reviews import NH

    m = tr.fit(training_rows(spark, sf), WINDOW_FEATURES, "logistic_regression", maxIter=20)
    return tr.scan(load_bars(spark, sf), m, ASOF, 150, 150, gate=NH).select("sample_id", "ts_code", "new_high_review_reason", "new_high_score_factor", "model_score", "score")


@query("two_model_scan")
def _scan_two(spark, sf):
    a, b = pair(spark, sf)
    return tr.scan_intersection(load_bars(spark, sf), a, b, ASOF, 50, window=150, min_history=150)


@query("latest_ensemble_scan")
def _latest(spark, sf):
    a, b = pair(spark, sf)
    f = scan_features(load_bars(spark, sf), ASOF, 150).drop("trade_date")
    return tr.latest_ensemble(f, a, b, 0.3, 50)


@query("pair_scoring")
def _pair(spark, sf):
    from barloom.plans.tracking import with_pair

    a, b = pair(spark, sf)
    f = scan_features(load_bars(spark, sf), ASOF, 150).drop("trade_date")
    return with_pair(tr.pair_scorer(a, b, "phase1")(f), "phase1").select("sample_id", "phase1_score_lgbm", "phase1_score_xgb", "phase1_score_mean", "phase1_score_min")


@query(
    "median_imputer",
    oracle(
        "select 'close' as feature, median(close) as value from x union all select 'vol', median(vol) from x union all select 'none', 0.0",
        "x as (select case when rn % 7 = 0 then null else close end as close, vol from (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars))", nums="value",
    ),
)
def _medians(spark, sf):
    b = load_bars(spark, sf).withColumn("rn", BARS.index())
    b = b.withColumns({"close": F.when(F.col("rn") % 7 != 0, F.col("close")), "none": F.lit(None).cast("double")})
    return spark.createDataFrame(list(tr.medians(b, ["close", "vol", "none"]).items()), "feature string, value double")


GAP_SCHEMA = T.StructType([T.StructField("ts_code", T.StringType()), T.StructField("asof_date", T.DateType()), T.StructField("gap", T.DoubleType())])


def gap_days(ts_code: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """Example user miner: days that open more than 3 percent away from two closes before."""
    gap = pdf["open"] / pdf["close"].shift(2) - 1
    hit = gap.abs() > 0.03
    return pd.DataFrame({"ts_code": ts_code, "asof_date": pdf["trade_date"][hit], "gap": gap[hit]})


@query(
    "user_miner",
    oracle(
        "select ts_code, trade_date as asof_date, gap from (select *, open / lag(close, 2) over (partition by ts_code order by trade_date) - 1 as gap from bars) where abs(gap) > 0.03",
        dates="asof_date", nums="gap",
    ),
)
def _user(spark, sf):
    return user_miner(load_bars(spark, sf), gap_days, GAP_SCHEMA)
