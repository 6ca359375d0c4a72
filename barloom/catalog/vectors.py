"""Feature vectors per window and training datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.timeseries import roll
from barloom.catalog.views import SAMPLES_SQL, samples
from barloom.functions.windows import BARS
from barloom.operators.features import HORIZONS, MEANS, WINDOW_FEATURES, daily_vector, trailing_drawdowns, window_vector
from barloom.plans.datasets import build_dataset, build_tabular, features_for_dates, scan_features
from barloom.session import stored
from barloom.sources.bars import load_bars

# per-window computation on the SQL side: every sample's own 150 bars, means restarted inside the window
VEC_SQL = SAMPLES_SQL + """, ix as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars),
vw as (select s.sample_id, b.*, b.rn - (e.rn - 150) as o from samples s join ix e on e.ts_code = s.ts_code and e.trade_date = s.asof_date
  join ix b on b.ts_code = s.ts_code and b.rn between e.rn - 149 and e.rn where e.rn >= 150),
vm as (select *, case when o >= 10 then avg(close) over (partition by sample_id order by o rows 9 preceding) end as m10,
  case when o >= 20 then avg(close) over (partition by sample_id order by o rows 19 preceding) end as m20,
  close / lag(close) over (partition by sample_id order by o) - 1 as ret from vw),
vec as (select sample_id, max(high) / min(low) - 1 as base_range_pct, stddev_pop(vol) / avg(vol) as base_vol_cv,
  avg(vol) filter (where o > 130) / avg(vol) filter (where o between 71 and 130) as vol_shrink_ratio,
  max(close) filter (where o = 150) / max(close) filter (where o = 145) - 1 as recent_return_5,
  max(close) filter (where o = 150) / max(close) filter (where o = 140) - 1 as recent_return_10,
  max(close) filter (where o = 150) / max(high) filter (where o between 130 and 149) - 1 as breakout_distance_20,
  max(close) filter (where o = 150) / max(high) filter (where o between 90 and 149) - 1 as breakout_distance_60,
  max(vol) filter (where o = 150) / avg(vol) filter (where o between 130 and 149) as volume_spike_ratio,
  avg(case when close > m10 then 1.0 else 0.0 end) filter (where m10 is not null) as above_ma10_ratio,
  avg(case when close > m20 then 1.0 else 0.0 end) filter (where m20 is not null) as above_ma20_ratio,
  stddev_pop(ret) filter (where o > 130) as volatility_20 from vm group by sample_id)"""
VEC_NUMS = " ".join(WINDOW_FEATURES)


@query(
    "dataset_build",
    oracle("select s.sample_id, s.ts_code, s.asof_date, s.label, v.* exclude (sample_id) from vec v join samples s using (sample_id)", VEC_SQL,
           dates="asof_date", nums=VEC_NUMS, ints="label"),
)
def _dataset(spark, sf):
    s = samples(spark, sf).drop("close")
    return build_dataset(s, load_bars(spark, sf), 150, 1)


@query(
    "dataset_skip_counts",
    oracle(
        "select case when rn >= 150 then 'ok' else 'insufficient_history' end as skip_reason, count(*) as n from samples s join ix e on e.ts_code = s.ts_code and e.trade_date = s.asof_date group by 1",
        SAMPLES_SQL + ", ix as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars)", ints="n",
    ),
)
def _skips(spark, sf):
    from barloom.operators.history import skip_reasons

    r = skip_reasons(samples(spark, sf).drop("close"), load_bars(spark, sf), 150, 1)
    return r.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_latest_features",
    oracle(
        "select split_part(sample_id, '_', 1) as ts_code, v.* exclude (sample_id) from vec v",
        VEC_SQL.replace(SAMPLES_SQL, """samples as (select concat(ts_code, '_', 'x') as sample_id, ts_code, max(trade_date) as asof_date from bars
          where trade_date <= '2001-06-30' group by ts_code)"""),
        nums=VEC_NUMS,
    ),
)
def _scan_features(spark, sf):
    f = scan_features(load_bars(spark, sf), "2001-06-30", 150)
    return f.select("ts_code", *WINDOW_FEATURES)


@query(
    "scan_longer_history",
    oracle(
        "select split_part(sample_id, '_', 1) as ts_code, v.* exclude (sample_id) from vec v",
        VEC_SQL.replace(SAMPLES_SQL, """samples as (select concat(ts_code, '_', 'x') as sample_id, ts_code, max(trade_date) as asof_date from bars
          where trade_date <= '1997-06-30' group by ts_code having count(*) >= 190)"""),
        nums=VEC_NUMS,
    ),
)
def _scan_history(spark, sf):
    """The history asked for is longer than the window: it is counted before the bars are cut."""
    return scan_features(load_bars(spark, sf), "1997-06-30", 150, 190).select("ts_code", *WINDOW_FEATURES)


@query(
    "features_for_dates",
    oracle(
        "select g.ts_code, cast(g.date as varchar) as asof_date, d.* exclude (ts_code, asof_date) from grid g asof join dv d on d.ts_code = g.ts_code and g.date >= d.asof_date",
        VEC_SQL + """, dv as (select s.ts_code, s.asof_date, v.* exclude (sample_id) from vec v join samples s using (sample_id)),
          grid as (select c.ts_code, d.date from (select distinct ts_code from bars) c cross join (select distinct trade_date as date from bars) d)""",
        nums=VEC_NUMS,
    ),
)
def _features_dates(spark, sf):
    from barloom.sources.universe import dense_dates

    b = load_bars(spark, sf)
    d = dense_dates(b).select(F.col("date").alias("asof_date"))
    return features_for_dates(b, d, 150).select("ts_code", F.col("asof_date").cast("string").alias("asof_date"), *WINDOW_FEATURES)


def _tab_sql() -> str:
    h = ", ".join(
        f"""last_close / nullif(max(close) filter (where o = n - {p}), 0) - 1 as ret_{p}d,
            case when any_value(n) >= {p} then stddev_pop(ret) filter (where o > n - {p}) end as volatility_{p}d,
            max(high) filter (where o > n - {p}) / min(low) filter (where o > n - {p}) - 1 as range_{p}d_pct,
            (last_close - min(low) filter (where o > n - {p})) / (max(high) filter (where o > n - {p}) - min(low) filter (where o > n - {p})) as close_pos_{p}d"""
        for p in HORIZONS
    )
    m = ", ".join(
        f"""last_close / max(m{p}) filter (where o = n) - 1 as close_vs_ma{p}, max(m{p}) filter (where o = n) / max(m{p}) filter (where o = n - 20) - 1 as ma{p}_slope_20d"""
        for p in MEANS
    )
    ma = ", ".join(f"case when o >= {p} then avg(close) over (partition by sample_id order by o rows {p - 1} preceding) end as m{p}" for p in MEANS)
    return SAMPLES_SQL + f""", ix as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars),
tw as (select s.sample_id, b.*, b.rn - greatest(e.rn - 504, 0) as o, least(e.rn, 504) as n, e.close as last_close from samples s
  join ix e on e.ts_code = s.ts_code and e.trade_date = s.asof_date join ix b on b.ts_code = s.ts_code and b.rn between e.rn - 503 and e.rn where e.rn >= 252),
tm as (select *, {ma}, close / lag(close) over (partition by sample_id order by o) - 1 as ret,
  close / max(close) over (partition by sample_id order by o rows unbounded preceding) - 1 as dd504,
  case when o > n - 252 then close / max(case when o > n - 252 then close end) over (partition by sample_id order by o rows unbounded preceding) - 1 end as dd252,
  max(high) filter (where o > n - 252) over (partition by sample_id) as top, min(low) filter (where o > n - 252) over (partition by sample_id) as bot from tw),
tab as (select sample_id, cast(any_value(n) as double) as history_bars, any_value(last_close) as current_close, {h}, {m},
  max(m20) filter (where o = n) / max(m60) filter (where o = n) - 1 as ma20_vs_ma60, max(m60) filter (where o = n) / max(m120) filter (where o = n) - 1 as ma60_vs_ma120,
  last_close / max(high) filter (where o > n - 252) - 1 as drawdown_from_252d_high, last_close / max(high) - 1 as drawdown_from_504d_high,
  last_close / min(low) filter (where o > n - 252) - 1 as distance_from_252d_low, last_close / min(low) - 1 as distance_from_504d_low,
  min(dd252) as max_drawdown_252d, min(dd504) as max_drawdown_504d,
  avg(vol) filter (where o > n - 20) / avg(vol) filter (where o > n - 60) as volume_ratio_20_60, avg(vol) filter (where o > n - 20) / avg(vol) filter (where o > n - 120) as volume_ratio_20_120,
  stddev_pop(vol) filter (where o > n - 120) / avg(vol) filter (where o > n - 120) as volume_cv_120,
  last_close / max(high) filter (where o > n - 61 and o < n) - 1 as breakout_distance_60d, last_close / max(high) filter (where o > n - 121 and o < n) - 1 as breakout_distance_120d,
  cast(any_value(n) - min(o) filter (where o > n - 252 and high = top) as double) as days_since_252d_high, cast(any_value(n) - min(o) filter (where o > n - 252 and low = bot) as double) as days_since_252d_low
  from tm group by sample_id, last_close, n)"""


TAB_NAMES = (
    ["history_bars", "current_close"]
    + [f"{k}_{p}d{'_pct' if k == 'range' else ''}" for p in HORIZONS for k in ("ret", "volatility", "range", "close_pos")]
    + [f"close_vs_ma{p}" for p in MEANS] + [f"ma{p}_slope_20d" for p in MEANS]
    + ["ma20_vs_ma60", "ma60_vs_ma120", "drawdown_from_252d_high", "drawdown_from_504d_high", "distance_from_252d_low", "distance_from_504d_low",
       "max_drawdown_252d", "max_drawdown_504d", "volume_ratio_20_60", "volume_ratio_20_120", "volume_cv_120", "breakout_distance_60d",
       "breakout_distance_120d", "days_since_252d_high", "days_since_252d_low"]
)


@query(
    "tabular_dataset",
    oracle("select s.sample_id, s.ts_code, s.asof_date, s.label, t.* exclude (sample_id) from tab t join samples s using (sample_id)", _tab_sql(),
           dates="asof_date", nums=" ".join(TAB_NAMES), ints="label"),
)
def _tabular(spark, sf):
    b = stored(load_bars(spark, sf))
    return build_tabular(samples(spark, sf, bars=b).drop("close"), b, 252, 504)


@query(
    "daily_vector_every_bar",
    oracle(
        f"""select ts_code, trade_date, cast(least(rn, 504) as double) as history_bars, close / lag(close, 20) over (partition by ts_code order by trade_date) - 1 as ret_20d,
            close / ({roll('avg', 'close', 120)}) - 1 as close_vs_ma120, close / max(high) over (partition by ts_code order by trade_date rows 503 preceding) - 1 as drawdown_from_504d_high
            from (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars)""",
        dates="trade_date", nums="history_bars ret_20d close_vs_ma120 drawdown_from_504d_high",
    ),
)
def _every_bar(spark, sf):
    v = daily_vector(load_bars(spark, sf))
    return v.select("ts_code", "trade_date", "history_bars", "ret_20d", "close_vs_ma120", "drawdown_from_504d_high")


@query(
    "window_vector_every_bar",
    oracle(
        f"""select ts_code, trade_date, max(high) over w / min(low) over w - 1 as base_range_pct, stddev_pop(vol) over w / avg(vol) over w as base_vol_cv,
            close / lag(close, 10) over (partition by ts_code order by trade_date) - 1 as recent_return_10
            from (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars) window w as (partition by ts_code order by trade_date rows 149 preceding)
            qualify rn >= 150""",
        dates="trade_date", nums="base_range_pct base_vol_cv recent_return_10",
    ),
)
def _window_every(spark, sf):
    return window_vector(load_bars(spark, sf), 150).select("ts_code", "trade_date", "base_range_pct", "base_vol_cv", "recent_return_10")


@query(
    "trailing_drawdown",
    oracle(
        """select a.ts_code, a.trade_date, min(b.close / b.peak) - 1 as max_drawdown_30d from ix a join (
             select x.ts_code, x.rn as end_rn, y.close, max(y.close) over (partition by x.ts_code, x.rn order by y.rn) as peak
             from ix x join ix y on y.ts_code = x.ts_code and y.rn between x.rn - 29 and x.rn) b on b.ts_code = a.ts_code and b.end_rn = a.rn group by 1, 2""",
        "ix as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars)",
        dates="trade_date", nums="max_drawdown_30d",
    ),
)
def _drawdown(spark, sf):
    return trailing_drawdowns(load_bars(spark, sf), "close", [30]).select("ts_code", "trade_date", "max_drawdown_30d")


@query(
    "bars_since_extreme",
    oracle(
        "select ts_code, trade_date, len(last) - list_position(last, list_max(last)) as since_high from (select ts_code, trade_date, list(high) over (partition by ts_code order by trade_date rows 251 preceding) as last from bars)",
        dates="trade_date", ints="since_high",
    ),
)
def _since(spark, sf):
    v = daily_vector(load_bars(spark, sf))
    return v.select("ts_code", "trade_date", F.col("days_since_252d_high").cast("bigint").alias("since_high"))


@query(
    "fast_window_slice",
    oracle(
        "select ts_code, trade_date, rn as pos from (select *, row_number() over (partition by ts_code order by trade_date) as rn, count(*) over (partition by ts_code) as n from bars) where n >= 150 and rn > n - 150",
        dates="trade_date", ints="pos",
    ),
)
def _slice(spark, sf):
    b = load_bars(spark, sf).withColumns({"pos": BARS.index(), "n": BARS.bars()})
    return b.where("n >= 150 and pos > n - 150").select("ts_code", "trade_date", "pos")
