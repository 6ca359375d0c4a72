"""The older two-leg detector: an impulse out of a quiet base, then a short pullback on lower volume."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import holds, limit_like
from barloom.functions.windows import BARS

TINY = 1e-9


@dataclass(frozen=True)
class PrefilterConfig:
    lookback: int = 25
    recent_days: int = 20
    min_pct_chg: float = 7.0
    min_turnover: float = 5.0
    vol_ratio: float = 1.8
    min_price: float = 5.0
    max_price: float = 120.0


def coarse_filter(bars: DataFrame, cfg: PrefilterConfig = PrefilterConfig()) -> DataFrame:
    """Symbols with an acceptable last close and a strong move, turnover or volume day in the recent bars."""
    b = bars.withColumns(
        {"__v5": BARS.mean("vol", 5), "__back": BARS.bars() - BARS.index(), "__n": BARS.bars()}
    ).where((F.col("__back") < cfg.recent_days) & (F.col("__n") >= max(10, cfg.lookback)))
    turnover = holds(F.col("turnover_rate") >= cfg.min_turnover) if "turnover_rate" in bars.columns else F.lit(False)
    strong = holds(F.col("pct_chg") >= cfg.min_pct_chg) | turnover | holds(F.col("vol") > F.col("__v5") * cfg.vol_ratio)
    per = b.groupBy("ts_code").agg(
        F.max(F.when(F.col("__back") == 0, F.col("close"))).alias("last_close"), F.bool_or(strong).alias("strong")
    )
    return per.where(F.col("last_close").between(cfg.min_price, cfg.max_price) & F.col("strong"))


def indicators(bars: DataFrame) -> DataFrame:
    """Price and volume means, true-range mean, 90/100-bar range and volume stability."""
    out = {f"ma{n}": BARS.mean("close", n) for n in (5, 10, 20, 30, 60, 120)}
    out |= {f"vma{n}": BARS.mean("vol", n) for n in (5, 10, 20, 30, 60, 120)}
    prev = BARS.lag("close")
    span = F.col("high") - F.col("low")
    tr = F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    df = bars.withColumn("__tr", tr)
    out |= {
        "atr14": BARS.mean("__tr", 14),
        "hhv90_prev": BARS.high("high", 90, lag=1),
        "llv100": BARS.low("low", 100),
        "hhv100": BARS.high("high", 100),
        "vol_mean_20": BARS.mean("vol", 20),
        "vol_mean_100": BARS.mean("vol", 100),
        "vol_std_100": BARS.std("vol", 100, sample=True),
    }
    df = df.withColumns(out).drop("__tr")
    return df.withColumns(
        {
            "vol_cv_100": F.col("vol_std_100") / (F.col("vol_mean_100") + TINY),
            "base_range_pct_100": (F.col("hhv100") - F.col("llv100")) / (F.col("llv100") + TINY),
            "vol_shrink_ratio": F.col("vol_mean_20") / (F.col("vol_mean_100") + TINY),
        }
    )


@dataclass(frozen=True)
class TwoLegConfig:
    base_lookback: int = 100
    base_max_range_pct: float = 0.35
    base_max_vol_cv: float = 0.80
    base_vol_shrink_ratio_max: float = 0.80
    impulse_lookback: int = 20
    breakout_lookback: int = 90
    min_impulse_pct: float = 0.07
    min_impulse_vol_ratio: float = 2.0
    min_turnover_rate: float = 3.0
    min_pullback_days: int = 2
    max_pullback_days: int = 8
    max_post_bars: int = 15
    min_pullback_pct: float = 0.03
    max_pullback_pct: float = 0.15
    max_pullback_vol_ratio: float = 0.75
    max_close_below_breakout_close: float = 0.06
    min_above_ma10_ratio: float = 0.97
    min_above_platform_ratio: float = 0.98
    min_price: float = 5.0
    max_price: float = 120.0
    start_date: str | None = None
    end_date: str | None = None


def two_leg(bars: DataFrame, cfg: TwoLegConfig = TwoLegConfig()) -> DataFrame:
    """One row per symbol whose last bar completes the pattern."""
    b = bars
    if cfg.start_date:
        b = b.where(F.col("trade_date") >= F.lit(cfg.start_date).cast("date"))
    if cfg.end_date:
        b = b.where(F.col("trade_date") <= F.lit(cfg.end_date).cast("date"))
    n = cfg.base_lookback
    c = F.col
    b = b.withColumns(
        {
            "rn": BARS.index(),
            "nb": BARS.bars(),
            "ma10": BARS.mean("close", 10),
            "ma20": BARS.mean("close", 20),
            "vma20": BARS.mean("vol", 20),
            "b_high": BARS.high("high", n, lag=1, min_periods=1),
            "b_low": BARS.low("low", n, lag=1, min_periods=1),
            "b_mean": BARS.mean("vol", n, lag=1, min_periods=1),
            "b_std": BARS.std("vol", n, sample=True, lag=1, min_periods=1),
            "b_mean20": BARS.mean("vol", 20, lag=1, min_periods=1),
            "platform": BARS.high("high", cfg.breakout_lookback, lag=1, min_periods=1),
        }
    ).where(c("nb") >= max(n + 30, 160))
    base_range = c("b_high") / (c("b_low") + TINY) - 1
    base_cv = c("b_std") / (c("b_mean") + TINY)
    vol_ratio = c("vol") / (c("b_mean20") + TINY)
    turnover = F.coalesce(c("turnover_rate") >= cfg.min_turnover_rate, F.lit(True)) if "turnover_rate" in b.columns else F.lit(True)
    impulse = holds(
        (c("rn") > c("nb") - cfg.impulse_lookback)
        & (c("rn") > n)
        & (base_range <= cfg.base_max_range_pct)
        & (base_cv <= cfg.base_max_vol_cv)
        & (c("b_mean20") / (c("b_mean") + TINY) <= cfg.base_vol_shrink_ratio_max)
        & ((c("pct_chg") >= cfg.min_impulse_pct * 100) | limit_like("ts_code", "pct_chg"))
        & (vol_ratio >= cfg.min_impulse_vol_ratio)
        & (c("close") > c("platform") * 0.98)
        & turnover
    )
    whole = W.partitionBy("ts_code")
    b = b.withColumns({"range_now": base_range, "cv_now": base_cv, "vr_now": vol_ratio, "imp": impulse})
    b = b.withColumn("imp_rn", F.max(F.when(c("imp"), c("rn"))).over(whole)).where("imp_rn is not null and rn >= imp_rn")
    # from here a symbol has at most impulse_lookback rows
    b = b.withColumn("top", F.max("high").over(whole))
    b = b.withColumn("top_rn", F.min(F.when(c("high") == c("top"), c("rn"))).over(whole))
    at_imp, at_last, after = c("rn") == c("imp_rn"), c("rn") == c("nb"), c("rn") > c("top_rn")
    v = lambda cond, x: F.max(F.when(cond, x))
    heavy = (c("rn") > c("nb") - 2) & (c("pct_chg") > 7.0) & (c("vol") > c("vma20") * 2)
    g = b.groupBy("ts_code").agg(
        v(at_last, c("trade_date")).alias("trade_date"), v(at_last, c("close")).alias("close"),
        v(at_last, c("ma10")).alias("ma10"), v(at_last, c("ma20")).alias("ma20"),
        v(at_imp, c("trade_date")).alias("impulse_date"), v(at_imp, c("close")).alias("imp_close"), v(at_imp, c("vol")).alias("imp_vol"),
        v(at_imp, c("pct_chg")).alias("impulse_pct_chg"), v(at_imp, c("vr_now")).alias("impulse_vol_ratio"),
        v(at_imp, c("platform")).alias("platform_high_before"), v(at_imp, c("range_now")).alias("base_range"), v(at_imp, c("cv_now")).alias("base_cv"),
        F.max("top").alias("first_leg_high"), F.count_if(after).alias("pullback_days"), F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(after, c("vol"))).alias("pull_vol"), F.bool_or(holds(heavy)).alias("heavy"),
    )
    depth = (c("first_leg_high") - c("close")) / (c("first_leg_high") + TINY)
    pvr = c("pull_vol") / (c("imp_vol") + TINY)
    g = g.where(
        c("close").between(cfg.min_price, cfg.max_price)
        & (c("rows") - 1).between(cfg.min_pullback_days, cfg.max_post_bars)
        & c("pullback_days").between(cfg.min_pullback_days, cfg.max_pullback_days)
        & depth.between(cfg.min_pullback_pct, cfg.max_pullback_pct)
        & (pvr <= cfg.max_pullback_vol_ratio)
        & (c("close") >= c("imp_close") * (1 - cfg.max_close_below_breakout_close))
        & F.coalesce(c("close") >= c("ma10") * cfg.min_above_ma10_ratio, F.lit(True))
        & (c("close") >= c("platform_high_before") * cfg.min_above_platform_ratio)
        & (c("close") < c("first_leg_high") * 0.98)
        & ~c("heavy")
    )
    zero = F.lit(0.0)
    score = (
        F.greatest(zero, 20 - c("base_range") * 40)
        + F.greatest(zero, 20 - c("base_cv") * 20)
        + F.least(F.lit(20.0), c("impulse_vol_ratio") * 4)
        + F.greatest(zero, 20 - depth * 100)
        + F.greatest(zero, 20 - pvr * 20)
    )
    r2 = lambda x: F.round(x, 2)
    return g.select(
        "ts_code", "trade_date", r2(c("close")).alias("close"), "impulse_date", r2(c("impulse_pct_chg")).alias("impulse_pct_chg"),
        r2(c("impulse_vol_ratio")).alias("impulse_vol_ratio"), r2(c("first_leg_high")).alias("first_leg_high"),
        r2(depth * 100).alias("pullback_pct"), "pullback_days", r2(pvr).alias("pullback_vol_ratio"), r2(c("ma10")).alias("ma10"),
        r2(c("ma20")).alias("ma20"), r2(c("platform_high_before")).alias("platform_high_before"), r2(score).alias("score"),
    )
