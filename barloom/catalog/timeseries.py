"""Window features over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.functions import windows as ts
from barloom.functions.cols import change, non_zero
from barloom.functions.windows import BARS
from barloom.sources.bars import load_bars

K = ("ts_code", "trade_date")
WIN = "window w as (partition by ts_code order by trade_date)"


def roll(agg: str, c: str, n: int, lag: int = 0, need: int | None = None) -> str:
    """SQL text of a guarded rolling aggregate."""
    lo, hi = n - 1 + lag, lag
    end = "current row" if hi == 0 else (f"{hi} preceding" if hi > 0 else f"{-hi} following")
    fr = f"over (partition by ts_code order by trade_date rows between {lo} preceding and {end})"
    return f"case when count({c}) {fr} >= {n if need is None else need} then {agg}({c}) {fr} end"


@query(
    "returns",
    oracle(
        f"""select ts_code, trade_date, close / nullif(lag(close, 1) over w, 0) - 1 as close_return_1,
            close / nullif(lag(close, 5) over w, 0) - 1 as close_return_5 from bars {WIN}""",
        dates="trade_date",
        nums="close_return_1 close_return_5",
    ),
)
def _returns(spark, sf):
    return ts.add_returns(load_bars(spark, sf), "close", (1, 5)).select(*K, "close_return_1", "close_return_5")


GAPPY = """gappy as (select ts_code, trade_date, case when day(trade_date) % 7 = 0 then null else close * 1.0471975511965976::double end as close from bars),
 filled as (select ts_code, trade_date, last_value(close ignore nulls) over
   (partition by ts_code order by trade_date rows between unbounded preceding and current row) as f,
   first_value(close ignore nulls) over
   (partition by ts_code order by trade_date rows between current row and unbounded following) as b from gappy)"""


def gappy(spark, sf):
    """Bars with the close missing on every seventh day of a month, scaled so that no mean ends in a rounding tie."""
    hole = F.dayofmonth("trade_date") % 7 == 0
    return load_bars(spark, sf).withColumn("close", F.when(~hole, F.col("close") * F.lit(1.0471975511965976)))


@query(
    "returns_filled",
    oracle(
        f"""select ts_code, trade_date, f / nullif(lag(f) over w, 0) - 1 as fwd_filled,
            b / nullif(lag(b) over w, 0) - 1 as back_filled from filled {WIN}""",
        GAPPY,
        dates="trade_date",
        nums="fwd_filled back_filled",
    ),
)
def _returns_filled(spark, sf):
    df = gappy(spark, sf)
    df = ts.add_returns(df, "close", (1,), "ffill").withColumnRenamed("close_return_1", "fwd_filled")
    df = ts.add_returns(df, "close", (1,), "bfill").withColumnRenamed("close_return_1", "back_filled")
    return df.select(*K, "fwd_filled", "back_filled")


@query(
    "lags",
    oracle(
        f"""select ts_code, trade_date, lag(close, 1) over w as close_lag_1, lag(close, 3) over w as close_lag_3,
            lag(vol, 1) over w as vol_lag_1, lag(vol, 3) over w as vol_lag_3 from bars {WIN}""",
        dates="trade_date",
        nums="close_lag_1 close_lag_3 vol_lag_1 vol_lag_3",
    ),
)
def _lags(spark, sf):
    df = ts.add_lags(load_bars(spark, sf), ["close", "vol"], (1, 3))
    return df.select(*K, "close_lag_1", "close_lag_3", "vol_lag_1", "vol_lag_3")


@query(
    "rolling_mean_std",
    oracle(
        f"""select ts_code, trade_date, {roll('avg', 'close', 5)} as close_rolling_mean_5,
            {roll('stddev_pop', 'close', 5)} as close_rolling_std_5,
            {roll('avg', 'close', 20)} as close_rolling_mean_20,
            {roll('stddev_pop', 'close', 20)} as close_rolling_std_20 from gappy""",
        GAPPY,
        dates="trade_date",
        nums="close_rolling_mean_5 close_rolling_std_5 close_rolling_mean_20 close_rolling_std_20",
    ),
)
def _rolling(spark, sf):
    df = ts.add_rolling(gappy(spark, sf), "close", (5, 20))
    return df.select(*K, *[c for c in df.columns if "rolling" in c])


@query(
    "rolling_mean_std_min_periods",
    oracle(
        f"""select ts_code, trade_date, {roll('avg', 'close', 20, need=5)} as close_rolling_mean_20,
            {roll('stddev_pop', 'close', 20, need=5)} as close_rolling_std_20 from gappy""",
        GAPPY,
        dates="trade_date",
        nums="close_rolling_mean_20 close_rolling_std_20",
    ),
)
def _rolling_min(spark, sf):
    df = ts.add_rolling(gappy(spark, sf), "close", (20,), min_periods=5)
    return df.select(*K, "close_rolling_mean_20", "close_rolling_std_20")


@query(
    "rolling_zscore",
    oracle(
        "select ts_code, trade_date, case when s > 0 then (close - m) / s end as zscore from r",
        f"""r as (select ts_code, trade_date, close, {roll('avg', 'close', 20)} as m,
            {roll('stddev_pop', 'close', 20)} as s from bars)""",
        dates="trade_date",
        nums="zscore",
    ),
)
def _zscore(spark, sf):
    return load_bars(spark, sf).select(*K, ts.rolling_zscore("close", 20).alias("zscore"))


@query(
    "rolling_volatility",
    oracle(
        f"""select ts_code, trade_date, {roll('stddev_pop', 'ret', 20)} as daily_vol,
            ({roll('stddev_pop', 'ret', 20)}) * sqrt(252) as annual_vol from r""",
        f"r as (select ts_code, trade_date, close / lag(close) over w - 1 as ret from bars {WIN})",
        dates="trade_date",
        nums="daily_vol annual_vol",
    ),
)
def _volatility(spark, sf):
    df = ts.add_rolling_volatility(load_bars(spark, sf), "close", 20).withColumnRenamed("close_volatility_20", "daily_vol")
    df = ts.add_rolling_volatility(df, "close", 20, 252).withColumnRenamed("close_volatility_20", "annual_vol")
    return df.select(*K, "daily_vol", "annual_vol")


@query(
    "winsorize",
    oracle(
        "select ts_code, trade_date, greatest(lo, least(hi, vol)) as vol_clipped from bars join b using (ts_code)",
        "b as (select ts_code, quantile_cont(vol, 0.01) as lo, quantile_cont(vol, 0.99) as hi from bars group by ts_code)",
        dates="trade_date",
        nums="vol_clipped",
    ),
)
def _winsorize(spark, sf):
    return load_bars(spark, sf).select(*K, ts.winsorize("vol").alias("vol_clipped"))


@query(
    "standardize",
    oracle(
        "select ts_code, trade_date, (close - m) / nullif(s, 0) as close_norm from bars join b using (ts_code)",
        "b as (select ts_code, avg(close) as m, stddev_pop(close) as s from bars group by ts_code)",
        dates="trade_date",
        nums="close_norm",
    ),
)
def _standardize(spark, sf):
    return load_bars(spark, sf).select(*K, ts.standardize("close").alias("close_norm"))


@query(
    "forward_return",
    oracle(
        f"""select ts_code, trade_date, lead(close, 1) over w / close - 1 as fwd_1,
            lead(close, 10) over w / close - 1 as fwd_10 from bars {WIN}""",
        dates="trade_date",
        nums="fwd_1 fwd_10",
    ),
)
def _forward_return(spark, sf):
    return load_bars(spark, sf).select(
        *K, ts.forward_return("close", 1).alias("fwd_1"), ts.regression_target("close", 10).alias("fwd_10")
    )


@query(
    "forward_label",
    oracle(
        f"""select ts_code, trade_date, case when f is not null then case when f > 0.01 then 1 else 0 end end as label
            from (select ts_code, trade_date, lead(close, 5) over w / close - 1 as f from bars {WIN})""",
        dates="trade_date",
        ints="label",
    ),
)
def _forward_label(spark, sf):
    return load_bars(spark, sf).select(*K, ts.forward_label("close", 5, 0.01).alias("label"))


@query(
    "regression_target",
    oracle(
        f"select ts_code, trade_date, lead(close, 3) over w / close - 1 as target from bars {WIN}",
        dates="trade_date",
        nums="target",
    ),
)
def _target(spark, sf):
    return load_bars(spark, sf).select(*K, ts.regression_target("close", 3).alias("target"))


@query(
    "basic_indicators",
    oracle(
        f"""select g.ts_code, g.trade_date, f.f / lag(f.f) over (partition by g.ts_code order by g.trade_date) - 1 as ret_1d,
            avg(g.close) over (partition by g.ts_code order by g.trade_date rows 4 preceding) as ma_5,
            avg(g.close) over (partition by g.ts_code order by g.trade_date rows 19 preceding) as ma_20
            from gappy g join filled f using (ts_code, trade_date)""",
        GAPPY,
        dates="trade_date",
        nums="ret_1d ma_5 ma_20",
    ),
)
def _indicators(spark, sf):
    return ts.basic_indicators(gappy(spark, sf)).select(*K, "ret_1d", "ma_5", "ma_20")


@query(
    "runup_rule",
    oracle(
        f"""select ts_code, trade_date, runup_pct, runup_pct <= 0.6 as runup_ok,
            case when runup_pct <= 0.6 then 2 else 0 end as score_bonus
            from (select ts_code, trade_date, close / ({roll('min', 'close', 150)}) - 1 as runup_pct from bars)""",
        dates="trade_date",
        nums="runup_pct",
        ints="score_bonus",
    ),
)
def _runup(spark, sf):
    run = change(F.col("close"), non_zero(BARS.low("close", 150)))
    ok = F.col("runup_pct") <= 0.6
    return load_bars(spark, sf).select(*K, run.alias("runup_pct")).select(
        *K, "runup_pct", ok.alias("runup_ok"), F.when(ok, 2).otherwise(0).alias("score_bonus")
    )


@query(
    "local_extrema",
    oracle(
        """select ts_code, trade_date, i > k and i <= n - k and close = lo as is_local_low,
           i > k and i <= n - k and close = hi as is_local_high from x where (i > k and i <= n - k and (close = lo or close = hi))""",
        """x as (select ts_code, trade_date, close, 5 as k,
             row_number() over (partition by ts_code order by trade_date) as i, count(*) over (partition by ts_code) as n,
             min(close) over (partition by ts_code order by trade_date rows between 5 preceding and 5 following) as lo,
             max(close) over (partition by ts_code order by trade_date rows between 5 preceding and 5 following) as hi from bars)""",
        dates="trade_date",
    ),
)
def _extrema(spark, sf):
    df = ts.local_extrema(load_bars(spark, sf))
    return df.where("is_local_low or is_local_high").select(*K, "is_local_low", "is_local_high")
