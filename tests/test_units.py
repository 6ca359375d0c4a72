"""Hand-made values, contracts and properties."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from barloom.catalog import modeling
from barloom.catalog.labeling import positive_candidates
from barloom.catalog.patterns import BASE_CFG, LONG_CFG
from barloom.catalog.reviews import STAGES
from barloom.functions import rolling, windows as ts
from barloom.functions.cols import toward_neutral
from barloom.functions.ordering import exact_quantiles, take_first, with_global_rank, with_running_totals
from barloom.operators import bases, labels as lb, metrics as mt, miners as mn, pullback as pb, review as rv, schema as sc, selection as sel, splits as sp
from barloom.operators.asof import asof_join
from barloom.operators.calendar import require_dates
from barloom.operators.features import WINDOW_FEATURES, daily_vector
from barloom.operators.history import history_window, history_windows, locate, sequence_matrix
from barloom.operators.review import CHIP_COLUMNS, apply_adjustments, ensure_pullback_metrics, overhang_ratio, price_histogram, reviewer_config
from barloom.operators.upsert import upsert
from barloom.plans import mining, training
from barloom.plans.datasets import features_for_dates
from barloom.plans.labels import build_label_set
from barloom.plans.tracking import phase1_cache, rank_phase1
from barloom.sources import chart, normalize as nz
from barloom.sources.bars import load_bars
from barloom.sources.contracts import ContractCatalog, DatasetContract, read_by_entity
from barloom.sources.universe import dense_dates


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def series(spark, values, code="A"):
    rows = [(code, day(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts_code string, trade_date date, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


def test_windows_are_arrays_of_a_block(spark):
    bars = spark.range(7).selectExpr("'A' as ts_code", "date_add(date'2024-01-01', int(id)) as trade_date", "if(id in (1, 2, 5), null, double(id)) as close")
    s = spark.sql("select 's' || d as sample_id, 'A' as ts_code, date_add(date'2024-01-01', d) as asof_date from (select explode(sequence(0, 8)) as d)")
    got = {r["sample_id"]: [x["rn"] for x in r["window"]] for r in history_windows(s, bars, 3, 3, ["close"]).collect()}
    assert got == {f"s{d}": [min(d, 6) - 1, min(d, 6), min(d, 6) + 1] for d in range(2, 9)}
    m = {r["sample_id"]: [x[0] for x in r["sequence"]] for r in sequence_matrix(history_windows(s, bars, 3, 3, ["close"]), ["close"]).collect()}
    assert m["s2"] == [0, 0, 0] and m["s3"] == [3, 3, 3] and m["s5"] == [3, 4, 4]


def test_histogram_per_position(spark):
    bars = spark.sql("select 'A' as ts_code, date_add(date'2024-01-01', i) as trade_date, c as close, 10D as vol from (select posexplode(array(5D, 5D, null, 1D, 2D)) as (i, c))")
    at = spark.sql("select 'A' as ts_code, explode(array(2L, 3L, 5L, 5L)) as pos")
    h = {r["pos"]: r for r in price_histogram(at, bars, 4, 4).collect()}
    assert (h[2]["bin_low"], h[2]["bin_high"], h[2]["last_bin"]) == (4.99, 5.01, 2)
    assert [(x["bin"], x["volume"]) for x in h[3]["bins"]] == [(2, 20.0)]
    assert [(x["bin"], x["volume"]) for x in h[5]["bins"]] == [(0, 10.0), (1, 10.0), (3, 10.0)] and h[5]["last_bin"] == 1
    ratios = {r["pos"]: r["overhang_ratio"] for r in overhang_ratio(price_histogram(at, bars, 4, 4)).collect()}
    assert ratios == {2: 0.0, 3: 0.0, 5: pytest.approx(1 / 3)}


def test_full_weight_keeps_tiny_factors(spark):
    df = spark.sql("select explode(array(1e-24D, 3e-24D, 0.5D)) as f")
    got = df.select("f", toward_neutral(F.col("f"), 1.0).alias("full"), toward_neutral(F.col("f"), 0.4).alias("part")).orderBy("f").collect()
    assert [r["full"] for r in got] == [1e-24, 3e-24, 0.5]
    assert got[2]["part"] == pytest.approx(0.8)


# ---------------------------------------------------------------- time series


def test_returns_and_fill(spark):
    df = series(spark, [10, None, 12])
    assert column(ts.add_returns(df, "close", (1,), "pad"), "close_return_1")[1:] == [0.0, pytest.approx(0.2)]
    assert column(ts.add_returns(df, "close"), "close_return_1") == [None, None, None]
    with pytest.raises(ValueError):
        ts.add_returns(df, "close", (1,), "linear")


def test_rolling_needs_full_window(spark):
    df = series(spark, [10, None, 12])
    assert column(ts.add_rolling(df, "close", (2,)), "close_rolling_mean_2") == [None, None, None]
    assert column(ts.add_rolling(df, "close", (2,), min_periods=1), "close_rolling_mean_2") == [10, 10, 12]


def test_forward_label(spark):
    df = series(spark, [10, 12, 9]).withColumn("y", ts.forward_label("close", 1)).withColumn("f", ts.forward_return("close"))
    assert column(df, "y") == [1, 0, None]
    assert column(df, "f")[:2] == [pytest.approx(0.2), pytest.approx(-0.25)]


def test_zscore_of_flat_series_is_null(spark):
    assert column(series(spark, [5, 5, 5]).withColumn("z", ts.rolling_zscore("close", 2)), "z") == [None] * 3


def test_plateau_counts_as_extremum_and_order_shrinks(spark):
    df = ts.local_extrema(series(spark, [3, 1, 1, 3]), order=5)
    assert column(df, "is_local_low") == [False, True, True, False]


# ---------------------------------------------------------------- as-of join


def test_asof_by_group_and_global(spark):
    left = spark.createDataFrame([("b", 3, 0), ("a", 2, 1), ("a", 4, 2)], "g string, t int, o int")
    right = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], "g string, t int, value int")
    vals = lambda d: [r["value"] for r in d.orderBy("o").collect()]
    assert vals(asof_join(left, right, "t", "g")) == [20, 10, 30]
    assert vals(asof_join(left, right, "t", "g", bounded=True)) == [20, 10, 30]
    assert vals(asof_join(left.drop("g"), right.drop("g"), "t")) == [30, 20, 30]
    assert vals(asof_join(left, right, "t", "g", "forward")) == [None, 30, None]
    with pytest.raises(ValueError):
        asof_join(left, right, "t", "g", "sideways")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bounded", [True, False])
def test_asof_random_against_brute_force(spark, direction, bounded):
    rng = random.Random(5)
    # one entity holds most rows, and instants repeat
    who = lambda: "hot" if rng.random() < 0.6 else rng.choice("xyz")
    left = [(i, who(), rng.randrange(60)) for i in range(200)]
    right = [(who(), rng.randrange(60), i) for i in range(150)]
    got = asof_join(
        spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "t", "k", direction, tie="v", bounded=bounded
    )
    got = {r["id"]: r["v"] for r in got.collect()}
    for i, k, t in left:
        back = max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=None)
        fwd = min(((rt, v) for rk, rt, v in right if rk == k and rt >= t), default=None)
        if direction == "backward":
            want = back
        elif direction == "forward":
            want = fwd
        else:
            want = back if fwd is None or (back is not None and t - back[0] <= fwd[0] - t) else fwd
        assert got[i] == (want[1] if want else None)


def test_history_window_guards(spark):
    bars = series(spark, range(5))
    s = spark.createDataFrame([("A", day(2))], "ts_code string, asof_date date")
    assert [r["close"] for r in history_window(s, bars, 2, 3, ["close"]).orderBy("offset").collect()] == [1, 2]
    assert history_window(s, bars, 2, 4).count() == 0
    assert history_window(s, bars, 4, 1).count() == 0


# ---------------------------------------------------------------- distributed order


def test_rank_totals_and_quantiles(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(2).alias("w"))
    ranked = with_global_rank(df, [F.desc("x")], "r")
    assert ranked.where("r <> 1000 - x").count() == 0
    run = with_running_totals(df, "x", {"c": "w"})
    assert run.where("c <> 2 * (x + 1)").count() == 0
    q = exact_quantiles(df, "x", [0.1, 0.5]).first()
    assert (q["q10"], q["q50"]) == (pytest.approx(99.9), pytest.approx(499.5))
    assert sorted(r["x"] for r in take_first(df, [F.asc("x")], 5, task_limit=1).collect()) == [0, 1, 2, 3, 4]


# ---------------------------------------------------------------- metrics


def test_metric_values(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.8), (1, 0.7), (0, 0.2)], "y int, s double")
    m = mt.classification_metrics(df, "y", "s").first()
    assert (m["accuracy"], m["auc"], m["f1"]) == (1.0, 1.0, 1.0)
    r = mt.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "y double, p double"), "y", "p").first()
    assert r["mae"] == 0.5
    ic = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0), (3.0, None), (4.0, 9.0)], "y double, s double")
    assert mt.information_coefficient(ic, "y", "s", rank=True).first()["ic"] == pytest.approx(1.0)


def test_one_class_has_no_auc(spark):
    m = mt.classification_metrics(spark.createDataFrame([(1, 0.1), (1, 0.8)], "y int, s double"), "y", "s").first()
    assert m["auc"] is None and m["recall"] == 0.5


# ---------------------------------------------------------------- contracts and schema


def test_contract_errors(spark, tmp_path):
    ok = {"dataset_id": "d", "storage": "csv", "path": "p", "entity_col": "e", "time_col": "t"}
    with pytest.raises(ValueError):
        DatasetContract.from_dict({**ok, "path": ""})
    with pytest.raises(ValueError):
        DatasetContract.from_dict({**ok, "storage": "orc"})
    c = DatasetContract.from_dict(ok)
    with pytest.raises(ValueError):
        ContractCatalog([c, c])
    cat = ContractCatalog([c, replace(c, dataset_id="a")])
    assert cat.ids() == ["a", "d"]
    with pytest.raises(KeyError):
        cat.get("z")
    with pytest.raises(ValueError):
        read_by_entity(spark, str(tmp_path))
    with pytest.raises(ValueError):
        read_by_entity(spark, str(tmp_path), -1)
    assert read_by_entity(spark, str(tmp_path), 3, ["a"]).count() == 0


def test_rename_errors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert sc.rename_columns(df, {"a": "x", "b": "a"}).columns == ["x", "a", "c"]
    for bad in ({"z": "x"}, {"a": "x", "b": "x"}, {"a": "c"}):
        with pytest.raises(ValueError):
            sc.rename_columns(df, bad)
    with pytest.raises(ValueError):
        sc.require_columns(df, ["a", "q"])
    assert sc.pick_column(df, ["vol", "B"]) == "b" and sc.pick_column(df, ["q"], required=False) is None


def test_label_aliases_and_feature_columns(spark):
    df = spark.createDataFrame([("A", day(0), 1, 2.0, "t")], "Ticker string, date date, y int, f double, note string")
    out = sc.label_schema(df)
    assert out.columns[:3] == ["ts_code", "asof_date", "label"]
    assert sc.feature_columns(out) == ["f"]
    with pytest.raises(ValueError):
        sc.require_unique(out.unionByName(out), ["ts_code"])


def test_duplicate_policy(spark):
    df = series(spark, [1, 2]).unionByName(series(spark, [5]))
    with pytest.raises(ValueError):
        nz.daily_with_units(df)
    one = nz.daily_with_units(df.withColumn("o", F.col("close")), "o", duplicates="last").orderBy("trade_date").collect()
    assert [r["close"] for r in one] == [5, 2]


def test_chart_error_stops(spark):
    df = spark.createDataFrame([("a", '{"chart": {"error": "no data", "result": null}}')], "symbol string, payload string")
    with pytest.raises(Exception, match="no data"):
        chart.daily_prices(df).collect()


def test_upsert_is_idempotent(spark):
    base, inc = series(spark, [1, 2, 3]), series(spark, [9]).unionByName(series(spark, [7], "B"))
    once = upsert(base, inc)
    assert sorted(map(tuple, upsert(once, inc).collect())) == sorted(map(tuple, once.collect()))
    assert once.count() == 4


def test_calendar_errors(spark):
    d = dense_dates(series(spark, [1, 2]))
    with pytest.raises(ValueError):
        require_dates(d, ["2031-01-01"])


# ---------------------------------------------------------------- registries


def test_miner_registry():
    assert len(mining.miner_names()) == 17
    assert mining.miner_config("type_n", {"type_n": {"lookback_window": 30, "unknown": 1}}).lookback_window == 30
    assert mining.miner_config("pullback_pattern", {"pullback": {"lookback_days": 50}}).lookback_days == 50
    assert mining.miner_config("w_bottom", {"rules": {"extrema_order": 3}, "windows": [{"name": "s", "lookback": 60}]}).windows[0].bars == 60
    assert mining.miner_config("long_base_breakout", {"scan": {"asof_stride": 3}, "monthly_trend": {"enable": True}}).monthly.enable
    with pytest.raises(ValueError):
        mining.miner_config("nope", {})


def test_model_and_reviewer_registry():
    assert training.model_names(["LR", "xgb"]) == ["logistic_regression", "xgboost"]
    with pytest.raises(ValueError):
        training.model_names(["lgbm", "lightgbm"])
    with pytest.raises(ValueError):
        training.model_name("svm")
    assert reviewer_config("none") == {} and "midlong_trend" in reviewer_config("ma120_trend_soft")
    with pytest.raises(ValueError):
        reviewer_config("other")


def test_negative_quota():
    assert lb.split_targets(11) == {"random_non_event": 4, "downtrend_continuation": 4, "weak_base_non_breakout": 3}


def test_pullback_metrics_are_reused(spark):
    df = spark.createDataFrame([(1.0,)], "phase2_pullback_volume_vs_pre double")
    assert ensure_pullback_metrics(df, None) is df


# ---------------------------------------------------------------- splits


def test_walk_forward_bounds(spark):
    rows = sp.walk_forward(spark, 10, 4, 2).collect()
    assert [(r["train_start"], r["test_start"], r["test_end"]) for r in rows] == [(0, 4, 6), (0, 6, 8), (0, 8, 10)]
    assert [r["train_start"] for r in sp.walk_forward(spark, 10, 4, 2, expanding=False).collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        sp.walk_forward(spark, 10, 4, 2, 0)


def test_temporal_check(spark):
    rows = [("train", day(0)), ("valid", day(5)), ("test", day(9))]
    mk = lambda r: mt.temporal_split_summary(spark.createDataFrame(r, "split string, asof_date date"))
    mt.check_temporal_split(mk(rows))
    for bad in (rows[:2], [("train", day(6)), *rows[1:]], [*rows[:2], ("test", day(5))]):
        with pytest.raises(ValueError):
            mt.check_temporal_split(mk(bad))


def test_stratified_quota(spark):
    df = spark.range(100).select(F.concat(F.lit("s"), "id").alias("sample_id"), (F.col("id") < 30).cast("int").alias("label"))
    n = {(r["label"], r["split"]): r["count"] for r in sp.stratified_split(df).groupBy("label", "split").count().collect()}
    assert n == {(0, "train"): 49, (0, "valid"): 10, (0, "test"): 11, (1, "train"): 21, (1, "valid"): 4, (1, "test"): 5}


# ---------------------------------------------------------------- selection and sequential rules


def test_spaced_selection_against_walk(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", rng.choice("AB"), rng.choice(["x", "y"]), day(rng.randrange(120)), round(rng.random(), 1)) for i in range(120)]
    rows = list({(r[1], r[2], r[3]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "sample_id string, ts_code string, window string, asof_date date, candidate_score double")
    got = {r["sample_id"] for r in sel.spaced_selection(df, ["ts_code", "window"], 15, 4).collect()}
    want = set()
    for code in "AB":
        kept = []
        for r in sorted((r for r in rows if r[1] == code), key=lambda r: (-r[4], r[3], r[0])):
            if all(r[2] != k[2] or abs((r[3] - k[3]).days) >= 15 for k in kept):
                kept.append(r)
        want |= {k[0] for k in kept[:4]}
    assert got == want


def test_separated_touches(spark):
    df = spark.sql("select array(named_struct('i', 1), named_struct('i', 5), named_struct('i', 12), named_struct('i', 20), named_struct('i', 22)) as t")
    assert [x["i"] for x in df.select(bases.separated_touches(F.col("t"), 10).alias("k")).first()["k"]] == [1, 12, 22]


def quantile(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo = int(pos)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (pos - lo)


def crossing(w, start, level):
    return next((i for i in range(start + 1, len(w)) if w[i]["close"] > level and w[i - 1]["close"] <= level), None)


def std_over_mean(v):
    m = sum(v) / len(v)
    return (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5 / m


def scan_positions(rows, cfg):
    top = max(w.bars for w in cfg.windows)
    return [i for i in range(top - 1, len(rows)) if (i - top + 1) % cfg.scan.asof_stride == 0]


def test_bottom_base_against_brute_force(spark, sf):
    """Every qualifying (symbol, date, window) found by plain loops, before the spacing rule."""
    cfg = replace(BASE_CFG, scan=replace(BASE_CFG.scan, min_days_between_candidates=0, max_candidates_per_symbol=0, asof_stride=3))
    bars = load_bars(spark, sf)
    got = {(r["ts_code"], r["asof_date"], r["window"]): r for r in bases.bottom_base_breakout(bars, cfg).collect()}
    by_code = {}
    for r in bars.orderBy("ts_code", "trade_date").collect():
        by_code.setdefault(r["ts_code"], []).append(r)
    want = {}
    for code, rows in by_code.items():
        for w in cfg.windows:
            n, base, guard = w.bars, cfg.base_bars(w.bars), cfg.max_breakout_recency_bars
            for at in scan_positions(rows, cfg):
                src = rows[max(0, at - guard - max(5, base - guard) + 1) : at - guard + 1]
                if at + 1 < n or not 0 < rows[at]["close"] / max(x["close"] for x in src) - 1 <= cfg.max_breakout_distance_pct:
                    continue
                win = rows[at - n + 1 : at + 1]
                off = n - base
                head = win[off : n - guard] if base > guard + 5 else win[off:-1]
                nk = max(range(len(head)), key=lambda i: (head[i]["close"], -i)) + off
                level = win[nk]["close"]
                b = crossing(win, nk, level)
                dist = win[-1]["close"] / level - 1
                if b is None or n - 1 - b > guard or not 0 <= dist <= cfg.max_breakout_distance_pct:
                    continue
                quiet = range(off, b)
                if len(quiet) < cfg.min_base_duration_bars:
                    continue
                low = min(quiet, key=lambda i: (win[i]["low"], i))
                lp = win[low]["low"]
                closes = [win[i]["close"] for i in quiet]
                if low == 0 or (max(closes) - lp) / lp > cfg.max_base_range_pct or std_over_mean(closes) > cfg.max_base_close_std_pct:
                    continue
                peak = max(x["high"] for x in win[:low])
                if (peak - lp) / peak < cfg.min_prior_drawdown_pct or level / lp - 1 < cfg.min_neckline_rebound_from_base_low_pct:
                    continue
                if win[-1]["close"] / lp - 1 < cfg.min_close_vs_base_low_pct or sum(c <= lp * 1.12 for c in closes) < 2:
                    continue
                want[code, win[-1]["trade_date"], w.name] = (level, lp, peak, win[b]["trade_date"])
    assert set(got) == set(want) and want
    for k, (level, lp, peak, b) in want.items():
        r = got[k]
        assert (r["neckline_price"], r["base_low_price"], r["prior_high_price"], r["breakout_date"]) == (level, lp, peak, b)


def test_long_base_against_brute_force(spark):
    cfg = replace(LONG_CFG, scan=replace(LONG_CFG.scan, min_days_between_candidates=0, max_candidates_per_symbol=0))
    bars = load_bars(spark, "/root/testdata/sf0.01")
    got = {(r["ts_code"], r["asof_date"], r["window"]): r for r in bases.long_base_breakout(bars, cfg).collect()}
    by_code = {}
    for r in bars.orderBy("ts_code", "trade_date").collect():
        by_code.setdefault(r["ts_code"], []).append(r)
    want = {}
    for code, rows in by_code.items():
        for w in cfg.windows:
            n, base, recent = w.bars, cfg.base_bars(w.bars), cfg.max_breakout_recency_bars
            for at in scan_positions(rows, cfg):
                length = max(20, int(n * 0.45))
                src = rows[max(0, at - recent - length + 1) : at - recent + 1]
                if at + 1 < n or not 0 < rows[at]["close"] / max(x["close"] for x in src) - 1 <= cfg.max_breakout_distance_pct:
                    continue
                win = rows[at - n + 1 : at + 1]
                off = n - base
                pre = range(off, n - recent)
                peak = max(x["high"] for x in win[: int(n * 0.45)])
                support = quantile([win[i]["close"] for i in pre] + [win[i]["low"] for i in pre], 0.10)
                touch = []
                for i in pre:
                    if win[i]["close"] <= support * 1.15 and (not touch or i - touch[-1] >= cfg.min_support_touch_separation_bars):
                        touch.append(i)
                if len(touch) < 2 or std_over_mean([win[i]["close"] for i in touch]) > cfg.max_support_zone_std_pct or (peak - support) / peak < 0.20:
                    continue
                cand = [i for i in pre if i > touch[0]]
                lo, hi = support * 1.15, peak * cfg.max_neckline_to_prior_high_ratio
                if len(cand) < 5:
                    continue
                inside = [i for i in cand if lo <= win[i]["close"] <= hi]
                if inside:
                    nk = max(inside, key=lambda i: (win[i]["close"], -i))
                else:
                    q = quantile([win[i]["close"] for i in cand], 0.85)
                    if not lo <= q <= hi:
                        continue
                    nk = min(cand, key=lambda i: (abs(win[i]["close"] - q), i))
                level = win[nk]["close"]
                b = crossing(win, nk, level)
                dist = win[-1]["close"] / level - 1
                if level / support - 1 < 0.15 or level / peak > cfg.max_neckline_to_prior_high_ratio or b is None:
                    continue
                if n - 1 - b > recent or not 0 < dist <= cfg.max_breakout_distance_pct or b - touch[-1] < cfg.min_right_side_duration_bars:
                    continue
                want[code, win[-1]["trade_date"], w.name] = (level, support, len(touch))
    assert set(got) == set(want) and want
    for k, (level, support, touches) in want.items():
        assert got[k]["neckline_price"] == level and got[k]["support_price"] == pytest.approx(support) and got[k]["support_touch_count"] == touches


# ---------------------------------------------------------------- properties


def test_no_future_data_in_samples(spark, sf):
    bars = load_bars(spark, sf).where("ts_code = 'S000001'")
    cut = "1999-01-01"
    changed = bars.withColumns({c: F.when(F.col("trade_date") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("close", "high", "low", "vol")})
    cfg = pb.Pullback(compute_future_returns=False)
    keep = lambda b: sorted(map(str, pb.pullback_samples(b, cfg, end_date=cut).collect()))
    assert keep(bars) == keep(changed)
    hits = lambda b: sorted(map(str, mn.scan_thresholds(b, {"type_n": mn.TypeN(top_n_per_symbol=0)}).where(F.col("asof_date") <= cut).collect()))
    assert hits(bars) == hits(changed)


def test_label_set_rules(spark, sf):
    out = build_label_set(positive_candidates(spark, sf), load_bars(spark, sf), positive_exclusion_days=30, train_end="1999-12-31", valid_end="2000-12-31").collect()
    pos = [r for r in out if r["label"] == 1]
    neg = [r for r in out if r["label"] == 0]
    assert pos and neg and len(neg) <= 3 * len(pos)
    for n in neg:
        assert all(p["ts_code"] != n["ts_code"] or abs((p["asof_date"] - n["asof_date"]).days) > 30 for p in pos)
    for i, a in enumerate(neg):
        assert all(a["ts_code"] != b["ts_code"] or abs((a["asof_date"] - b["asof_date"]).days) >= 20 for b in neg[i + 1 :])
    per = {}
    for n in neg:
        per[n["ts_code"]] = per.get(n["ts_code"], 0) + 1
    assert max(per.values()) <= 50


def gappy(spark, sf):
    """Bars of a few entities with missing closes and volumes."""
    h = F.crc32(F.concat("ts_code", F.col("trade_date").cast("string")))
    b = load_bars(spark, sf).where("ts_code <= 'S000004'")
    return b.withColumns({"vol": F.when(h % 7 != 0, F.col("vol")), "close": F.when(h % 13 != 0, F.col("close"))}).localCheckpoint()


def test_series_have_the_values_of_windows(spark, sf):
    b, w = gappy(spark, sf), ts.BARS
    want = {
        "mean": w.mean("close", 30, lag=2), "mean1": w.mean("close", 30, min_periods=1), "std": w.std("vol", 25, min_periods=1), "samp": w.std("vol", 25, sample=True, min_periods=3),
        "top": w.high("close", 37, lag=1, min_periods=1), "bottom": w.low("close", 21, min_periods=1), "lag": w.lag("close", 700), "ret": w.pct("close", 3),
    }

    def compute(s):
        c, v = s["close"], s["vol"]
        return {
            "mean": c.mean(30, lag=2), "mean1": c.mean(30, min_periods=1), "std": v.std(25, min_periods=1), "samp": v.std(25, sample=True, min_periods=3),
            "top": c.high(37, lag=1, min_periods=1), "bottom": c.low(21, min_periods=1), "lag": c.lag(700), "ret": c.change(3),
        }

    native = b.withColumns(want)
    got = rolling.per_entity(b, ["close", "vol"], list(want), compute).select(*native.columns)
    assert got.count() == b.count() and got.exceptAll(native).isEmpty()


def test_an_entity_may_lie_in_many_batches(spark, sf):
    b = gappy(spark, sf)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    count = lambda: rolling.per_entity(b, ["vol"], ["n"], lambda s: {"n": rolling.Series(s["vol"].count(10_000) * 1.0, s["vol"].known)}).agg(F.max("n"), F.sum("n")).first()
    whole = count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert count() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_meet_dates_without_another_shuffle(spark, sf):
    b = gappy(spark, sf).checkpoint() if spark.sparkContext.getCheckpointDir() else gappy(spark, sf)
    dates = spark.sql("select explode(sequence(date'1996-12-20', date'1997-01-20', interval 3 day)) as asof_date")
    f = features_for_dates(b, dates, 30, 1)
    assert plan_of(f).count("hashpartitioning(ts_code") <= 1
    keys = b.select("ts_code").distinct().join(dates).select("asof_date", "ts_code")
    by_key = features_for_dates(b, dates, 30, 1, codes=keys)
    assert f.count() > 0 and f.exceptAll(by_key).isEmpty() and by_key.exceptAll(f).isEmpty()


def test_bounded_asof_needs_no_join(spark):
    left = spark.sql("select * from values ('a', 3, 'x'), ('a', 3, 'y'), ('a', null, 'z'), (null, 9, 'n'), ('b', 5, 'b'), ('c', 1, 'c') as t(g, t, id)")
    right = spark.sql("select * from values ('a', 1, 10), ('a', 3, 30), ('a', null, 99), (null, 2, 20), ('b', 6, 60), ('b', 4, null) as t(g, t, v)")
    back, ahead = (asof_join(left, right, "t", "g", d, bounded=True, matched_on="m") for d in ("backward", "forward"))
    vals = lambda df: {r["id"]: (r["v"], r["m"]) for r in df.collect()}
    assert vals(back) == {"x": (30, 3), "y": (30, 3), "z": (None, None), "n": (20, 2), "b": (None, 4), "c": (None, None)}
    assert vals(ahead) == {"x": (30, 3), "y": (30, 3), "z": (None, None), "n": (None, None), "b": (60, 6), "c": (None, None)}
    assert "Join" not in plan_of(back)


def test_first_high_of_a_lookback():
    import numpy as np

    x = np.array([3.0, 5.0, 0.0, 5.0, 1.0, 2.0])
    high, since, low = rolling.Series(x, np.array([True, True, False, True, True, True])).first_high(3)
    assert list(high.values) == [3, 5, 5, 5, 5, 5] and list(since.values) == [0, 0, 1, 2, 1, 2]
    assert list(low.values) == [3, 3, 3, 5, 5, 5]


def test_reviewed_phase1_brings_its_trend_along(spark, sf):
    b = gappy(spark, sf)
    dates = spark.sql("select explode(sequence(date'1997-06-20', date'1997-07-20', interval 3 day)) as asof_date")
    config = {"midlong_trend": {"enabled": True, "score_col": "phase1_score_mean", "output_score_col": "adjusted_phase1_score"}}
    scorer = lambda df: df.withColumns({"phase1_score_lgbm": F.col("recent_return_5"), "phase1_score_xgb": F.col("recent_return_10")})
    top = phase1_cache(b, dates, scorer, 3, 30, reviewer=config)
    assert plan_of(top).count("Exchange hashpartitioning(ts_code") == 1
    plain = phase1_cache(b, dates, scorer, 1000, 30)
    joined = rank_phase1(apply_adjustments(plain.drop("phase1_rank"), b, config), 3, "adjusted_phase1_score")
    key = lambda df: {(r["anchor_date"], r["ts_code"]): (r["phase1_rank"], r["adjusted_phase1_score"], r["trend_data_date"]) for r in df.collect()}
    assert key(top) and key(top) == key(joined)


def test_daily_vector_is_one_stage(spark, sf):
    v = daily_vector(gappy(spark, sf))
    assert plan_of(v).count("Window ") == 1
    row = v.where("ts_code = 'S000001' and pos = 300").first()
    assert row["history_bars"] == 300 and row["max_drawdown_252d"] <= 0 and 0 <= row["days_since_252d_high"] < 252


@pytest.mark.parametrize("stage, anchor, own", [("chip_structure", "chip_anchor_date", "chip_pre_weight_avg_mean"), ("phase2_volume_hold", "phase2_anchor_date", "phase2_pre_avg_volume")])
def test_anchored_metrics_come_with_the_candidate(spark, stage, anchor, own):
    """A key with two anchors keeps its two rows, each with its own figures, and candidates are not joined again."""
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    cost = ", ".join(f"{c} double" for c in CHIP_COLUMNS)
    rows = [(code, day(i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, float(100 + i * i), *[float(i)] * 7) for code in ("A", "B") for i in range(30)]
    bars = spark.createDataFrame(rows, f"ts_code string, trade_date date, open double, high double, low double, close double, vol double, {cost}")
    found = [("a", "A", day(25), day(5)), ("a", "A", day(25), day(15)), ("b", "B", day(25), None), ("c", "C", day(25), day(5))]
    cand = spark.createDataFrame(found, "sample_id string, ts_code string, asof_date date, best_phase1_date date").withColumn("phase2_score_mean", F.lit(1.0))
    out = apply_adjustments(cand, bars, {stage: {"enabled": True, "anchor_date_col": "best_phase1_date"}})
    got = sorted((r["sample_id"], str(r["best_phase1_date"]), str(r[anchor]), r[own]) for r in out.collect())
    mean = lambda f, n: sum(map(f, n)) / len(n)
    first, second = [(float, range(0, 5)), (float, range(0, 15))] if stage == "chip_structure" else [(lambda i: 100.0 + i * i, range(0, 5)), (lambda i: 100.0 + i * i, range(0, 15))]
    late = str(day(5)) if stage == "chip_structure" else "None"
    assert got == [("a", str(day(5)), str(day(5)), mean(*first)), ("a", str(day(15)), str(day(15)), mean(*second)), ("b", "None", "None", None), ("c", str(day(5)), late, None)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_label_pools_take_no_sliding_frame_in_spark(spark, sf):
    """Frames of up to 252 bars are taken in numpy, and the walk over a symbol's queue equals its plain statement."""
    for pool in (lb.downtrend_pool, lb.weak_base_pool):
        plan = pool(load_bars(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f"(RowFrame, -{n}, " in plan for n in (59, 119, 60, 120, 252))
    rng = random.Random(5)
    rows = [(code, day(i)) for code in ("A", "B", "C") for i in rng.sample(range(400), 150)]
    taken = [("A", day(i)) for i in (10, 200)]
    pool = spark.createDataFrame(rows, "ts_code string, asof_date date")
    got = {(r["ts_code"], r["asof_date"]) for r in lb.accept(pool, spark.createDataFrame(taken, pool.schema), 1000, 9, 12, 42).collect()}
    order = pool.withColumn("h", sel.hash_order(42, "ts_code", "asof_date")).orderBy("ts_code", "h").collect()
    want, held = set(), {c: [d for k, d in taken if k == c] for c in "ABC"}
    for r in order:
        mine = held[r["ts_code"]]
        if len(mine) < 9 and all(abs((r["asof_date"] - d).days) >= 12 for d in mine):
            mine.append(r["asof_date"])
            want.add((r["ts_code"], r["asof_date"]))
    assert got == want and len(want) > 20


def test_models_of_the_training_split_get_its_rows_alone(spark, sf):
    """The rows of the training split, computed from its bars and stored without keys."""
    got = modeling.training_rows(spark, sf)
    want = modeling.dataset(spark, sf).where("split = 'train'").select("label", *WINDOW_FEATURES)
    assert got.columns == ["label", *WINDOW_FEATURES]
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    cut = load_bars(spark, sf).where(F.col("trade_date") <= F.lit(modeling.TRAIN_END).cast("date"))
    upto = load_bars(spark, sf, modeling.TRAIN_END)
    assert upto.count() == cut.count() > 0 and upto.exceptAll(cut).count() == 0


def test_the_pair_stores_no_row_of_another_split(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "fit", lambda d, *a, **k: seen.append(d))
    monkeypatch.setattr(modeling, "dataset", lambda *a: pytest.fail("the rows of all splits were computed"))
    modeling.pair(spark, sf)
    assert len(seen) == 2 and seen[0] is seen[1]


def test_adjustments_move_bars_and_candidates_once(spark, sf):
    """All stages take their metrics in one shuffle without a join, with the values of the window expressions and of the histogram."""
    w = ts.BARS
    b = gappy(spark, sf).unionByName(load_bars(spark, sf).where("ts_code between 'S000005' and 'S000006'"))
    b = b.withColumns({"ma_bfq_20": w.mean("close", 20), "ma_bfq_60": F.when(F.dayofmonth("trade_date") % 9 != 0, w.mean("close", 60))}).localCheckpoint()
    each = b.select("ts_code", "trade_date").unionByName(spark.sql("select 'S000001' as ts_code, date'1980-01-01' as trade_date union all select 'S000002', null union all select 'none', date'1997-01-01'"))
    moved = F.when(F.dayofmonth("trade_date") % 7 == 0, F.date_add("trade_date", 1)).otherwise(F.col("trade_date"))
    cand = each.select(F.monotonically_increasing_id().cast("string").alias("sample_id"), "ts_code", moved.alias("asof_date"), F.date_sub("trade_date", 10).alias("best_phase1_date"), F.lit(1.0).alias("baseline_score")).localCheckpoint()
    out = apply_adjustments(cand, b, STAGES | {"runup": {"enabled": True, "window": 30}, "base_stability": {"enabled": True, "window": 5}})
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    exact = rv.with_volume_metrics(rv.with_base_stability(b.withColumns({"runup_30": rv.runup_metric(30), **rv.burst_metrics(), **rv.box_metrics()}), 5))
    exact = exact.withColumnRenamed("volume_ratio", "volume_ratio_3d_20")
    names = [c for c in exact.columns if c not in b.columns]
    trend = rv.attach_trend(cand, b, rv.Trend())
    over = locate(cand, b).join(overhang_ratio(price_histogram(locate(cand, b), b)), ["ts_code", "pos"], "left")
    over = over.withColumn("overhang_ratio", F.when(F.col("ts_code") != "none", F.coalesce("overhang_ratio", F.lit(0.0))))
    for want, columns in ((rv.attach_metrics(cand, exact, names), names), (trend, rv.TREND_COLUMNS), (over, ["overhang_ratio"])):
        want, got = (df.select("sample_id", *columns) for df in (want, out))
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    full = out.agg(*[F.count(c).alias(c) for c in [*names, *rv.TREND_COLUMNS, "overhang_ratio", "phase2_pullback_depth_pct"]]).first()
    assert min(full) > 100


def test_a_brought_trend_needs_no_bars(spark, sf):
    b = gappy(spark, sf)
    cand = rv.attach_trend(b.select(F.concat("ts_code", F.col("trade_date").cast("string")).alias("sample_id"), "ts_code", F.col("trade_date").alias("asof_date"), F.lit(2.0).alias("score")), b).localCheckpoint()
    out = apply_adjustments(cand, b, {"midlong_trend": {"enabled": True, "score_col": "score", "output_score_col": "adjusted"}})
    assert "Exchange" not in plan_of(out) and out.where("adjusted is not null").count() == cand.count()


def test_overhang_comes_beside_the_bars(spark):
    """A candidate's share of volume above its price, in one shuffle: 0 before the first bar, NULL without bars."""
    rows = [("A", day(i), c, v) for i, (c, v) in enumerate([(10.0, 5.0), (20.0, 7.0), (None, 9.0), (14.0, 2.0)])]
    bars = spark.createDataFrame(rows, "ts_code string, trade_date date, close double, vol double")
    found = [("a", "A", day(1)), ("b", "A", day(2)), ("c", "A", day(9)), ("d", "A", day(-1)), ("e", "B", day(1)), ("f", "A", None)]
    out = rv.attach_overhang(spark.createDataFrame(found, "sample_id string, ts_code string, asof_date date"), bars, 3, 4)
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {r["sample_id"]: r["overhang_ratio"] for r in out.collect()} == {"a": 0.0, "b": 0.0, "c": 7.0 / 9.0, "d": 0.0, "e": None, "f": 0.0}
