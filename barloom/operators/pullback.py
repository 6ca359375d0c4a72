"""Pullback sampler: labels every bar by whether it sits in a simple pullback after a recent rise."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import change, holds, ratio, sample_id
from barloom.functions.rolling import Series, per_entity
from barloom.functions.windows import BARS


@dataclass(frozen=True)
class Pullback:
    lookback_days: int = 90
    min_rise_into_high_pct: float = 0.10
    min_drawdown_pct: float = 0.03
    max_drawdown_pct: float = 0.25
    min_pullback_speed_pct_per_day: float = 0.0
    min_days_since_high: int = 1
    max_days_since_high: int = 40
    positive_label_subtype: str = "simple_pullback"
    label_source: str = "pullback_pattern"
    compute_future_returns: bool = True
    future_windows: tuple[int, ...] = (5, 10, 20)
    prefix: str = "diagnostic_"

    @classmethod
    def from_dict(cls, data: dict | None) -> "Pullback":
        """Accepts top-level parameters or ``pullback`` and ``diagnostics`` blocks; blocks win."""
        data = dict(data or {})
        flat = {**data, **(data.get("pullback") or {}), **(data.get("diagnostics") or {})}
        if "future_windows" in flat:
            flat["future_windows"] = tuple(flat["future_windows"])
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in flat.items() if k in known})


FASTDROP = Pullback(
    min_rise_into_high_pct=0.15, min_drawdown_pct=0.06, max_drawdown_pct=0.22, max_days_since_high=10,
    min_pullback_speed_pct_per_day=0.008,
)


def derived(bars: DataFrame, lookback: int) -> DataFrame:
    """Distance to three means, 20-bar sample volatility and volume against its 20-bar mean; the first highest close of the
    lookback, the bars since then and the lowest close up to it."""

    def frames(s: dict[str, Series]) -> dict[str, Series]:
        close = s["close"]
        means = {f"__ma{n}": close.mean(n) for n in (5, 20, 60)}
        high, since, low = close.first_high(lookback)
        day = s["__day"].values[np.arange(len(since)) - since.values.astype(int)]
        highest = {"__high": high, "__since": since, "__low": low, "__high_day": Series(day, high.known)}
        return {**means, **highest, "__v20": s["vol"].mean(20), "volatility_20d": close.last_known().change(1).std(20, sample=True)}

    names = ["__ma5", "__ma20", "__ma60", "__v20", "__high", "__since", "__low", "__high_day", "volatility_20d"]
    df = per_entity(bars.withColumn("__day", F.unix_date("trade_date")), ["close", "vol", "__day"], names, frames)
    out = {f"ma{n}_distance": change(F.col("close"), F.col(f"__ma{n}")) for n in (5, 20, 60)}
    out["volume_ratio_20"] = ratio(F.col("vol"), F.col("__v20"))
    return df.withColumns(out).drop("__ma5", "__ma20", "__ma60", "__v20", "__day")


def forward_diagnostics(cfg: Pullback) -> dict:
    """Highest, lowest and closing return of the next bars; the close needs the full horizon."""
    now, out = F.col("close"), {}
    for n in cfg.future_windows:
        ahead = BARS.rows(1, n)
        full = F.count("close").over(ahead) >= n
        out[f"{cfg.prefix}future_max_return_{n}d"] = F.when(now > 0, change(F.max("high").over(ahead), now))
        out[f"{cfg.prefix}future_min_return_{n}d"] = F.when(now > 0, change(F.min("low").over(ahead), now))
        out[f"{cfg.prefix}future_close_return_{n}d"] = F.when((now > 0) & full, change(BARS.lag("close", -n), now))
    return out


def pullback_samples(
    bars: DataFrame,
    cfg: Pullback = Pullback(),
    *,
    latest_only: bool = False,
    asof_date: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    stride: int = 1,
) -> DataFrame:
    """Samples for every bar with enough history, the last bar, one date, or a strided date range."""
    n = cfg.lookback_days
    df = bars.where("trade_date is not null").withColumns({"rn": BARS.index(), "nb": BARS.bars()})
    if cfg.compute_future_returns:
        df = df.withColumns(forward_diagnostics(cfg))
    df = derived(df, n).where(F.col("rn") >= n)
    if latest_only:
        df = df.where("rn = nb")
    elif asof_date:
        df = df.where(F.col("trade_date") == F.lit(asof_date).cast("date"))
    else:
        if start_date:
            df = df.where(F.col("trade_date") >= F.lit(start_date).cast("date"))
        if end_date:
            df = df.where(F.col("trade_date") <= F.lit(end_date).cast("date"))
        if stride > 1:
            first = F.min("rn").over(W.partitionBy("ts_code"))
            df = df.withColumn("__first", first).where((F.col("rn") - F.col("__first")) % stride == 0)
    df = df.withColumns(
        {
            "days_since_high": F.col("__since").cast("int"),
            "recent_high": F.col("__high"),
            "recent_high_date": F.date_from_unix_date(F.col("__high_day").cast("int")),
            "lookback_low": F.col("__low"),
            "valid": holds(F.col("close") > 0) & F.col("__high").isNotNull(),
        }
    ).drop("__high", "__since", "__low", "__high_day")
    df = df.withColumns(
        {
            "rise_into_high_pct": F.when(F.col("lookback_low") > 0, F.col("recent_high") / F.col("lookback_low") - 1.0),
            "drawdown_from_high": F.when(F.col("recent_high") > 0, F.col("close") / F.col("recent_high") - 1.0),
        }
    )
    df = df.withColumn("pullback_depth_pct", -F.col("drawdown_from_high"))
    df = df.withColumn(
        "pullback_speed_pct_per_day", F.when(F.col("days_since_high") > 0, F.col("pullback_depth_pct") / F.col("days_since_high"))
    )
    rise, depth, days, speed = (F.col(c) for c in ("rise_into_high_pct", "pullback_depth_pct", "days_since_high", "pullback_speed_pct_per_day"))
    no_rise = ~holds(rise >= cfg.min_rise_into_high_pct)
    none = (days < cfg.min_days_since_high) | ~holds(depth >= cfg.min_drawdown_pct)
    subtype = (
        F.when(~F.col("valid"), "invalid_price")
        .when(no_rise, "no_prior_rise")
        .when(none, "no_pullback")
        .when(days > cfg.max_days_since_high, "stale_pullback")
        .when(depth > cfg.max_drawdown_pct, "too_deep_drawdown")
        .when(~holds(speed >= cfg.min_pullback_speed_pct_per_day), "slow_pullback")
        .otherwise(cfg.positive_label_subtype)
    )
    path = "prior_rise;has_pullback;"
    flags = (
        F.when(F.col("label_subtype") == "invalid_price", "")
        .when(F.col("label_subtype") == "no_prior_rise", "no_prior_rise")
        .when(F.col("label_subtype") == "no_pullback", "prior_rise;no_meaningful_pullback")
        .when(F.col("label_subtype") == cfg.positive_label_subtype, path + "pullback_depth_ok;days_since_high_ok;pullback_speed_ok")
        .otherwise(F.concat(F.lit(path), F.col("label_subtype")))
    )
    df = df.withColumn("label_subtype", subtype)
    sid = sample_id("ts_code", "trade_date")
    good = lambda c: F.when(F.col("valid"), c)
    turnover = F.col("turnover_ratio").cast("double") if "turnover_ratio" in bars.columns else F.lit(None).cast("double")
    kept = ["recent_high_date", "recent_high", "days_since_high", "lookback_low", "rise_into_high_pct"]
    measured = ["drawdown_from_high", "pullback_depth_pct", "pullback_speed_pct_per_day", "ma5_distance", "ma20_distance", "ma60_distance", "volatility_20d", "volume_ratio_20"]
    return df.select(
        sid.alias("sample_id"),
        "ts_code",
        F.col("trade_date").alias("asof_date"),
        (F.col("label_subtype") == cfg.positive_label_subtype).cast("int").alias("label"),
        F.lit("pattern").alias("label_type"),
        F.lit(cfg.label_source).alias("label_source"),
        "label_subtype",
        F.lit(1.0).alias("confidence"),
        good(F.concat(sid, F.lit("_pullback"))).alias("event_id"),
        *[good(F.col(c)).alias(c) for c in kept],
        good(F.col("close")).alias("current_close"),
        good(F.col("vol")).alias("current_volume"),
        *[good(F.col(c)).alias(c) for c in measured],
        good(turnover).alias("turnover_ratio"),
        flags.alias("rule_flags"),
        *([c for c in df.columns if c.startswith(cfg.prefix)] if cfg.compute_future_returns else []),
    )


def pullback_negatives(bars: DataFrame, cfg: Pullback = Pullback(), **mode) -> DataFrame:
    return pullback_samples(bars, cfg, **mode).where("label = 0")


def pullback_job(bars: DataFrame, cfg: Pullback = Pullback(), **mode) -> DataFrame:
    return pullback_samples(bars, cfg, **mode).orderBy(F.desc("asof_date"), "ts_code")
