"""Feature vectors of the window that ends at each bar.

Both vectors are expressed over the running series, so one window stage serves every bar and a sample only looks up its
bar.  Means inside a window need full frames, and those only see bars of the window, so the values equal a per-window
computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import safe_change, safe_ratio
from barloom.functions.rolling import Series, per_entity
from barloom.functions.windows import BARS

WINDOW_FEATURES = [
    "base_range_pct", "base_vol_cv", "vol_shrink_ratio", "recent_return_5", "recent_return_10", "breakout_distance_20",
    "breakout_distance_60", "volume_spike_ratio", "above_ma10_ratio", "above_ma20_ratio", "volatility_20",
]


def window_vector(bars: DataFrame, window: int = 150, min_history: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """The 11-feature vector at every bar with a full window (``pos`` is the bar's position), next to the columns ``carry``."""
    if window < 21:
        raise ValueError("window must cover at least 21 bars")
    c = F.col("close")
    prior, span = min(60, window - 20), min(60, window - 1)

    def frames(s: dict[str, Series]) -> dict[str, Series]:
        high, low, close, vol = (s[n] for n in ("high", "low", "close", "vol"))
        anyrow = dict(min_periods=1)
        return {
            "__hi": high.high(window, **anyrow),
            "__lo": low.low(window, **anyrow),
            "__hi20": high.high(20, lag=1, **anyrow),
            "__hi60": high.high(span, lag=1, **anyrow) if window >= 61 else high.high(window, **anyrow),
            "__sd": vol.std(window, **anyrow),
            "__mu": vol.mean(window, **anyrow),
            "__mu20": vol.mean(20, **anyrow),
            "__mu60": vol.mean(prior, lag=20, **anyrow),
            "__muv": vol.mean(20, lag=1, **anyrow),
            "__r10": close.above(close.mean(10)).mean(window - 9, **anyrow),
            "__r20": close.above(close.mean(20)).mean(window - 19, **anyrow),
            "__sdr": close.last_known().change(1).std(20, **anyrow),
            "__c5": close.lag(5),
            "__c10": close.lag(10),
        }

    names = ["__hi", "__lo", "__hi20", "__hi60", "__sd", "__mu", "__mu20", "__mu60", "__muv", "__r10", "__r20", "__sdr", "__c5", "__c10"]
    df = bars.withColumn("pos", BARS.index()).select("ts_code", "trade_date", "pos", *carry, "high", "low", "close", "vol")
    df = per_entity(df, ["high", "low", "close", "vol"], names, frames).where(F.col("pos") >= max(window, min_history))
    return df.select(
        "ts_code",
        "trade_date",
        "pos",
        *carry,
        safe_change(F.col("__hi"), F.col("__lo")).alias("base_range_pct"),
        safe_ratio(F.col("__sd"), F.col("__mu")).alias("base_vol_cv"),
        safe_ratio(F.col("__mu20"), F.col("__mu60")).alias("vol_shrink_ratio"),
        safe_change(c, F.col("__c5")).alias("recent_return_5"),
        safe_change(c, F.col("__c10")).alias("recent_return_10"),
        safe_change(c, F.col("__hi20")).alias("breakout_distance_20"),
        safe_change(c, F.col("__hi60")).alias("breakout_distance_60"),
        safe_ratio(F.col("vol"), F.col("__muv")).alias("volume_spike_ratio"),
        F.col("__r10").alias("above_ma10_ratio"),
        F.col("__r20").alias("above_ma20_ratio"),
        F.col("__sdr").alias("volatility_20"),
    )


def recent_bars(bars: DataFrame, asof_date: str, window: int) -> DataFrame:
    """Bars that the windows of one as-of date can touch: the last ``window`` (plus one return) per entity.

    ``history`` counts the entity's bars up to the date, those that are cut off included.
    """
    upto = bars.where(F.col("trade_date") <= F.lit(asof_date).cast("date"))
    back = F.row_number().over(BARS.whole.orderBy(F.desc("trade_date")))
    counted = upto.withColumns({"__back": back, "history": F.count(F.lit(1)).over(BARS.whole)})
    return counted.where(F.col("__back") <= window + 1).drop("__back")


def _combine(older: tuple[Column, Column, Column], newer: tuple[Column, Column, Column]):
    """(max, min, worst close/peak) of two adjacent stretches, either of which may be absent."""
    top, low = F.greatest(older[0], newer[0]), F.least(older[1], newer[1])
    return top, low, F.least(older[2], newer[2], newer[1] / older[0])


def trailing_drawdowns(df: DataFrame, column: str, spans: list[int]) -> DataFrame:
    """Worst close/peak - 1 over the last n rows for each n in ``spans``.

    Stretches of doubling length are combined from two shorter ones, so a row costs log(n) lookups and not n.
    """
    v = F.col(column)
    df = df.withColumns({"__x0": v, "__n0": v, "__d0": F.when(v.isNotNull(), F.lit(1.0))})
    levels = max(spans).bit_length()
    for k in range(1, levels):
        half = 1 << (k - 1)
        old = tuple(BARS.lag(f"__{p}{k - 1}", half) for p in "xnd")
        new = tuple(F.col(f"__{p}{k - 1}") for p in "xnd")
        df = df.withColumns({f"__{p}{k}": c for p, c in zip("xnd", _combine(old, new))})
    out = {}
    for n in spans:
        acc, used = None, 0
        for k in range(levels):
            if n >> k & 1:
                part = tuple(BARS.lag(f"__{p}{k}", used) for p in "xnd")
                acc = part if acc is None else _combine(part, acc)
                used += 1 << k
        # materialise part by part: window expressions cannot be nested in later levels
        out[f"max_drawdown_{n}d"] = acc[2] - 1.0
    df = df.withColumns(out)
    return df.drop(*[f"__{p}{k}" for p in "xnd" for k in range(levels)])


HORIZONS = (5, 10, 20, 60, 120, 252)
MEANS = (20, 60, 120, 200)


def daily_vector(bars: DataFrame, max_window: int = 504) -> DataFrame:
    """The 49-feature vector at every bar over at most ``max_window`` trailing bars."""
    c, long = F.col("close"), max_window

    def frames(s: dict[str, Series]) -> dict[str, Series]:
        high, low, close, vol = (s[n] for n in ("high", "low", "close", "vol"))
        anyrow = dict(min_periods=1)
        ret, worst = close.change(1), close.drawdowns([252, long])
        means = {n: close.mean(n) for n in MEANS}
        return {
            **{f"__ma{n}": m for n, m in means.items()},
            **{f"__mb{n}": m.lag(20) for n, m in means.items()},
            **{f"__h{n}": high.high(n, **anyrow) for n in (*HORIZONS, long)},
            **{f"__l{n}": low.low(n, **anyrow) for n in (*HORIZONS, long)},
            **{f"__c{n}": close.lag(n) for n in HORIZONS},
            **{f"__sd{n}": ret.std(n, **anyrow) for n in HORIZONS},
            **{f"__v{n}": vol.mean(n, **anyrow) for n in (20, 60, 120)},
            **{f"__d{n}": worst[n] for n in (252, long)},
            "__sdv": vol.std(120, **anyrow),
            "__p60": high.high(60, lag=1, **anyrow),
            "__p120": high.high(120, lag=1, **anyrow),
            # ties go to the oldest bar
            "__since_hi": high.since_extreme(252, 1),
            "__since_lo": low.since_extreme(252, -1),
        }

    names = [f"__{k}{n}" for k, spans in (("ma", MEANS), ("mb", MEANS), ("h", (*HORIZONS, long)), ("l", (*HORIZONS, long)), ("c", HORIZONS), ("sd", HORIZONS), ("v", (20, 60, 120)), ("d", (252, long))) for n in spans]
    df = bars.withColumn("pos", BARS.index()).select("ts_code", "trade_date", "pos", "high", "low", "close", "vol")
    df = per_entity(df, ["high", "low", "close", "vol"], [*dict.fromkeys(names), "__sdv", "__p60", "__p120", "__since_hi", "__since_lo"], frames)
    feats: dict[str, Column] = {"history_bars": F.least(F.col("pos"), F.lit(long)).cast("double"), "current_close": c}
    for n in HORIZONS:
        h, lo = F.col(f"__h{n}"), F.col(f"__l{n}")
        feats[f"ret_{n}d"] = safe_change(c, F.col(f"__c{n}"))
        feats[f"volatility_{n}d"] = F.when(F.col("pos") >= n, F.col(f"__sd{n}"))
        feats[f"range_{n}d_pct"] = safe_change(h, lo)
        feats[f"close_pos_{n}d"] = safe_ratio(c - lo, h - lo)
    for n in MEANS:
        feats[f"close_vs_ma{n}"] = safe_change(c, F.col(f"__ma{n}"))
        feats[f"ma{n}_slope_20d"] = safe_change(F.col(f"__ma{n}"), F.col(f"__mb{n}"))
    feats["ma20_vs_ma60"] = safe_change(F.col("__ma20"), F.col("__ma60"))
    feats["ma60_vs_ma120"] = safe_change(F.col("__ma60"), F.col("__ma120"))
    feats["drawdown_from_252d_high"] = safe_change(c, F.col("__h252"))
    feats[f"drawdown_from_{long}d_high"] = safe_change(c, F.col(f"__h{long}"))
    feats["distance_from_252d_low"] = safe_change(c, F.col("__l252"))
    feats[f"distance_from_{long}d_low"] = safe_change(c, F.col(f"__l{long}"))
    feats["max_drawdown_252d"] = F.col("__d252") - 1.0
    feats[f"max_drawdown_{long}d"] = F.col(f"__d{long}") - 1.0
    feats["volume_ratio_20_60"] = safe_ratio(F.col("__v20"), F.col("__v60"))
    feats["volume_ratio_20_120"] = safe_ratio(F.col("__v20"), F.col("__v120"))
    feats["volume_cv_120"] = safe_ratio(F.col("__sdv"), F.col("__v120"))
    feats["breakout_distance_60d"] = safe_change(c, F.col("__p60"))
    feats["breakout_distance_120d"] = safe_change(c, F.col("__p120"))
    feats["days_since_252d_high"] = F.col("__since_hi")
    feats["days_since_252d_low"] = F.col("__since_lo")
    return df.select("ts_code", "trade_date", "pos", *[e.alias(n) for n, e in feats.items()])
