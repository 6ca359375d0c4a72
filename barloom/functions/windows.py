"""Per-entity time-series expressions.

Every expression uses the same (entity, time) window so that any number of them share one exchange and one sort.  A
group holds one row per day, so its size is bounded by the calendar and not by the data volume (see
``sources.bars.one_row_per_day``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import change, col, non_zero, ratio


@dataclass(frozen=True)
class Axis:
    """Entity and time columns of a panel."""

    entity: str = "ts_code"
    time: str = "trade_date"

    @property
    def spec(self):
        return W.partitionBy(self.entity).orderBy(self.time)

    @property
    def whole(self):
        return W.partitionBy(self.entity)

    def rows(self, start: int, end: int):
        return self.spec.rowsBetween(start, end)

    @property
    def upto(self):
        return self.spec.rowsBetween(W.unboundedPreceding, 0)

    def lag(self, c: Column | str, n: int = 1) -> Column:
        if n == 0:
            return col(c)
        return F.lag(col(c), n).over(self.spec) if n > 0 else F.lead(col(c), -n).over(self.spec)

    def filled(self, c: Column | str) -> Column:
        """Last known value."""
        return F.last(col(c), ignorenulls=True).over(self.upto)

    def back_filled(self, c: Column | str) -> Column:
        return F.first(col(c), ignorenulls=True).over(self.rows(0, W.unboundedFollowing))

    def index(self) -> Column:
        return F.row_number().over(self.spec)

    def bars(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)

    def roll(self, agg, c: Column | str, n: int, *, lag: int = 0, min_periods: int | None = None) -> Column:
        """Aggregate of the ``n`` rows ending ``lag`` rows ago; NULL with fewer than ``min_periods`` known values."""
        frame = self.rows(-(n - 1) - lag, -lag)
        need = n if min_periods is None else min_periods
        value = agg(col(c)).over(frame)
        if need <= 1:
            return value
        return F.when(F.count(col(c)).over(frame) >= need, value)

    def mean(self, c, n, **kw) -> Column:
        return self.roll(F.avg, c, n, **kw)

    def high(self, c, n, **kw) -> Column:
        return self.roll(F.max, c, n, **kw)

    def low(self, c, n, **kw) -> Column:
        return self.roll(F.min, c, n, **kw)

    def std(self, c, n, *, sample: bool = False, **kw) -> Column:
        return self.roll(F.stddev_samp if sample else F.stddev_pop, c, n, **kw)

    def pct(self, c: Column | str, n: int = 1) -> Column:
        """Change over ``n`` rows, no fill."""
        return change(col(c), self.lag(c, n))


BARS = Axis()


def add_returns(df: DataFrame, column: str, periods=(1,), fill_method: str | None = None, axis: Axis = BARS) -> DataFrame:
    if fill_method not in (None, "ffill", "pad", "bfill", "backfill"):
        raise ValueError(f"unsupported fill_method: {fill_method}")
    source = column
    if fill_method:
        source = f"__{column}_filled"
        fill = axis.filled if fill_method in ("ffill", "pad") else axis.back_filled
        df = df.withColumn(source, fill(column))
    out = df.withColumns({f"{column}_return_{n}": axis.pct(source, n) for n in periods})
    return out.drop(source) if fill_method else out


def add_lags(df: DataFrame, columns, lags=(1,), axis: Axis = BARS) -> DataFrame:
    if any(n <= 0 for n in lags):
        raise ValueError("lags must be positive")
    return df.withColumns({f"{c}_lag_{n}": axis.lag(c, n) for c in columns for n in lags})


def add_rolling(df: DataFrame, column: str, windows=(5, 20), min_periods: int | None = None, axis: Axis = BARS) -> DataFrame:
    out = {}
    for n in windows:
        if n <= 0:
            raise ValueError("windows must be positive")
        out[f"{column}_rolling_mean_{n}"] = axis.mean(column, n, min_periods=min_periods)
        out[f"{column}_rolling_std_{n}"] = axis.std(column, n, min_periods=min_periods)
    return df.withColumns(out)


def rolling_zscore(column: str, n: int, min_periods: int | None = None, axis: Axis = BARS) -> Column:
    mean = axis.mean(column, n, min_periods=min_periods)
    std = axis.std(column, n, min_periods=min_periods)
    return ratio(F.col(column) - mean, non_zero(std))


def add_rolling_volatility(
    df: DataFrame, column: str, n: int, periods_per_year: int | None = None, axis: Axis = BARS
) -> DataFrame:
    df = df.withColumn("__ret", axis.pct(column, 1))
    vol = axis.std("__ret", n)
    if periods_per_year:
        vol = vol * F.sqrt(F.lit(float(periods_per_year)))
    return df.withColumn(f"{column}_volatility_{n}", vol).drop("__ret")


def winsorize(column: str, lower: float = 0.01, upper: float = 0.99, axis: Axis = BARS) -> Column:
    """Clip to the entity's own linear quantiles."""
    if not 0 <= lower <= upper <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower <= upper <= 1")
    c = F.col(column)
    bounds = F.percentile(c, F.array(F.lit(lower), F.lit(upper))).over(axis.whole)
    return F.when(c.isNotNull(), F.greatest(bounds[0], F.least(bounds[1], c)))


def standardize(column: str, axis: Axis = BARS) -> Column:
    """Population z-score within the entity; NULL when the spread is zero."""
    c = F.col(column)
    return ratio(c - F.avg(c).over(axis.whole), non_zero(F.stddev_pop(c).over(axis.whole)))


def forward_return(column: str, periods: int = 1, axis: Axis = BARS) -> Column:
    if periods <= 0:
        raise ValueError("periods must be positive")
    return change(axis.lag(column, -periods), F.col(column))


regression_target = forward_return


def forward_label(column: str, periods: int = 1, threshold: float = 0.0, axis: Axis = BARS) -> Column:
    fwd = forward_return(column, periods, axis)
    return F.when(fwd.isNotNull(), (fwd > threshold).cast("int"))


def basic_indicators(df: DataFrame, axis: Axis = BARS) -> DataFrame:
    """One-day return over the last known close, and 5/20-bar means that start with the first bar."""
    df = df.withColumn("__close", axis.filled("close"))
    return df.withColumns(
        {
            "ret_1d": axis.pct("__close", 1),
            "ma_5": axis.mean("close", 5, min_periods=1),
            "ma_20": axis.mean("close", 20, min_periods=1),
        }
    ).drop("__close")


def local_extrema(df: DataFrame, column: str = "close", order: int = 5, axis: Axis = BARS) -> DataFrame:
    """Mark interior bars that equal the min (max) of their +-order neighbourhood; plateaus all count.

    The order shrinks to (n-1)/2 on short entities, so one expression per possible order is built.
    """
    df = df.withColumns({"__i": axis.index(), "__n": axis.bars()})
    eff = F.when(F.col("__n") < 3, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(order), F.floor((F.col("__n") - 1) / 2).cast("int")))
    )
    low = high = None
    for k in range(1, order + 1):
        lo = F.min(column).over(axis.rows(-k, k)) == F.col(column)
        hi = F.max(column).over(axis.rows(-k, k)) == F.col(column)
        low = F.when(eff == k, lo) if low is None else low.when(eff == k, lo)
        high = F.when(eff == k, hi) if high is None else high.when(eff == k, hi)
    inside = (F.col("__i") > eff) & (F.col("__i") <= F.col("__n") - eff)
    return df.withColumns(
        {
            "is_local_low": F.coalesce(inside & low, F.lit(False)),
            "is_local_high": F.coalesce(inside & high, F.lit(False)),
        }
    ).drop("__i", "__n")
