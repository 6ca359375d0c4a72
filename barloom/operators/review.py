"""Review metrics of candidates and the multiplicative score adjustments built on them.

Bar metrics are columns of one window stage over bars.  The adjustments take all their metrics beside the bars of an entity
(``metrics_np``): bars and candidates move once, however many stages are on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import (
    change,
    clamp,
    holds,
    interpolate,
    non_zero,
    ratio,
    scale_factor,
    sigmoid_boost,
    sigmoid_decay,
    sigmoid_rise,
    toward_neutral,
)
from barloom.functions.rolling import Lookup, Series, beside_bars
from barloom.functions.windows import BARS
from barloom.operators import metrics_np as mx
from barloom.operators.asof import asof_join
from barloom.operators.history import block_bars, block_start, history_window, locate

KEYS = ["sample_id", "ts_code", "asof_date"]


@dataclass
class Part:
    """Metrics that candidates take beside their entity's bars: what they read, what they give, and how that becomes columns."""

    inputs: list[str]
    outputs: list[str]
    compute: Callable[[Lookup], dict[str, Series]]
    days: dict[str, Column] = field(default_factory=lambda: {"now": F.col("asof_date")})
    own: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


def beside(candidates: DataFrame, bars: DataFrame, parts: list[Part], distinct: bool = False) -> DataFrame:
    """Candidates with the metrics of all parts, in one shuffle of bars and candidates; no join follows."""
    rows, days, inputs, outputs, computes = candidates, {}, [], [], [p.compute for p in parts]
    for p in parts:
        rows, days, outputs = rows.withColumns(p.own) if p.own else rows, days | p.days, outputs + p.outputs
        inputs += [c for c in dict.fromkeys(p.inputs) if c not in inputs]

    def compute(x: Lookup) -> dict[str, Series]:
        found = {}
        for one in computes:
            found.update(one(x))
        return found

    out = beside_bars(rows, bars, days, inputs, outputs, compute, distinct=distinct)
    for p in parts:
        out = p.finish(out)
    return out

# ------------------------------------------------------------------ bar metrics


def runup_metric(window: int = 150) -> Column:
    return change(F.col("close"), non_zero(BARS.low("close", window)))


def with_volume_metrics(bars: DataFrame, ma_window: int = 20, short_window: int = 3, spike_ratio: float = 1.8) -> DataFrame:
    """Short mean against the mean of earlier days, and the length of the current run of spike days."""
    base = non_zero(BARS.mean("vol", ma_window, lag=1))
    df = bars.withColumns(
        {"volume_ratio": ratio(BARS.mean("vol", short_window), base), "__spike": holds(ratio(F.col("vol"), base) >= spike_ratio)}
    )
    df = df.withColumn("__run", F.count_if(~F.col("__spike")).over(BARS.upto))
    inside = W.partitionBy("ts_code", "__run").orderBy("trade_date").rowsBetween(W.unboundedPreceding, 0)
    streak = F.when(F.col("__spike"), F.count_if(F.col("__spike")).over(inside)).otherwise(F.lit(0))
    return df.withColumn("volume_spike_streak", streak.cast("bigint")).drop("__spike", "__run")


def burst_metrics(volume_window: int = 20, recent_high_window: int = 30) -> dict[str, Column]:
    c = F.col("close")
    vb = non_zero(BARS.mean("vol", volume_window, lag=1))
    ab = non_zero(BARS.mean("amount", volume_window, lag=1))
    high = non_zero(BARS.high("high", recent_high_window, lag=1, min_periods=1))
    return {
        "burst_ret_1d": change(c, non_zero(BARS.lag("close", 1))),
        "burst_ret_2d": change(c, non_zero(BARS.lag("close", 2))),
        "burst_volume_ratio_1d": ratio(F.col("vol"), vb),
        "burst_volume_ratio_2d": ratio(BARS.mean("vol", 2), vb),
        "burst_amount_ratio_1d": ratio(F.col("amount"), ab),
        "burst_amount_ratio_2d": ratio(BARS.mean("amount", 2), ab),
        "burst_recent_high": high,
        "burst_breakout_pct": change(c, high),
        "burst_close_position": ratio(c - F.col("low"), F.col("high") - F.col("low")),
    }


def with_base_stability(
    bars: DataFrame,
    window: int = 60,
    fast: str = "ma_bfq_20",
    slow: str = "ma_bfq_60",
    trend: str | None = None,
    prior_lag: int | None = None,
    recent_weight: float = 0.7,
    prior_weight: float = 0.3,
) -> DataFrame:
    """Root mean square of the lagged gap between two means, and the slopes of a trend mean before the trigger bar."""
    lag2 = window * 2 if prior_lag is None else prior_lag
    slow_c = non_zero(F.col(slow))
    df = bars.withColumns({"__gap": ratio(F.col(fast) - slow_c, slow_c), "__trend": non_zero(F.col(trend or slow))})
    df = df.withColumn("__gap2", F.col("__gap") * F.col("__gap"))
    t1, t2, t3 = (BARS.lag("__trend", n) for n in (1, window + 1, lag2 + 1))
    df = df.withColumns(
        {
            "base_ma_gap_l2": F.sqrt(BARS.mean("__gap2", window, lag=1)),
            "base_ma60_recent_slope_pct": change(t1, t2),
            "base_ma60_prior_slope_pct": change(t2, t3),
        }
    )
    trend_abs = F.lit(recent_weight) * F.abs("base_ma60_recent_slope_pct") + F.lit(prior_weight) * F.abs("base_ma60_prior_slope_pct")
    return df.withColumn("base_ma60_trend_abs", trend_abs).drop("__gap", "__trend", "__gap2")


def box_metrics(window: int = 60, high: str = "high", close: str = "close") -> dict[str, Column]:
    top = non_zero(BARS.high(high, window, lag=1))
    return {"box_high": top, "box_breakout_pct": change(F.col(close), top)}


@dataclass(frozen=True)
class Trend:
    short_window: int = 20
    mid_window: int = 60
    long_window: int = 120
    slope_lag: int = 20
    return_window: int = 120
    position_window: int = 120
    min_return: float = 0.0
    min_mid_ma_slope: float = 0.0
    min_position: float = 0.45
    require_above_mid_ma: bool = True


def with_trend_metrics(bars: DataFrame, t: Trend = Trend()) -> DataFrame:
    """Stored means where present, rolling means otherwise; price against them, slopes, return and range position."""
    c = F.col("close")

    def mean(n: int) -> Column:
        stored = f"ma_bfq_{n}"
        rolled = BARS.mean("close", n)
        return F.coalesce(F.col(stored), rolled) if stored in bars.columns else rolled

    df = bars.withColumns({"trend_ma_short": mean(t.short_window), "trend_ma_mid": mean(t.mid_window), "trend_ma_long": mean(t.long_window)})
    hi = BARS.high("high", t.position_window, min_periods=1)
    lo = BARS.low("low", t.position_window, min_periods=1)
    df = df.withColumns(
        {
            "trend_data_date": F.col("trade_date"),
            "trend_close": c,
            "trend_price_vs_mid_ma": change(c, F.col("trend_ma_mid")),
            "trend_price_vs_long_ma": change(c, F.col("trend_ma_long")),
            "trend_mid_ma_slope": change(F.col("trend_ma_mid"), BARS.lag("trend_ma_mid", t.slope_lag)),
            "trend_long_ma_slope": change(F.col("trend_ma_long"), BARS.lag("trend_ma_long", t.slope_lag)),
            "trend_return": change(c, BARS.lag("close", t.return_window)),
            "trend_position": ratio(c - lo, hi - lo),
        }
    )
    flags = [
        holds(F.col("trend_return") >= t.min_return),
        holds(F.col("trend_mid_ma_slope") >= t.min_mid_ma_slope),
        holds(F.col("trend_position") >= t.min_position),
    ]
    if t.require_above_mid_ma:
        flags.append(holds(F.col("trend_price_vs_mid_ma") >= 0))
    passed = flags[0]
    for f in flags[1:]:
        passed = passed & f
    share = sum([f.cast("int") for f in flags], F.lit(0)) / F.lit(float(len(flags)))
    return df.withColumns({"trend_midlong_score": share, "trend_midlong_pass": passed})


TREND_COLUMNS = [
    "trend_data_date", "trend_close", "trend_ma_short", "trend_ma_mid", "trend_ma_long", "trend_price_vs_mid_ma",
    "trend_price_vs_long_ma", "trend_mid_ma_slope", "trend_long_ma_slope", "trend_return", "trend_position",
    "trend_midlong_score", "trend_midlong_pass",
]
BURST_COLUMNS = [
    "burst_ret_1d", "burst_ret_2d", "burst_volume_ratio_1d", "burst_volume_ratio_2d", "burst_amount_ratio_1d",
    "burst_amount_ratio_2d", "burst_recent_high", "burst_breakout_pct", "burst_close_position",
]


def attach_metrics(candidates: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """Left join on the exact bar; a candidate without a bar gets NULLs."""
    right = bars.select("ts_code", F.col("trade_date").alias("asof_date"), *columns)
    return candidates.join(right, ["ts_code", "asof_date"], "left")


def attach_trend(candidates: DataFrame, bars: DataFrame, t: Trend = Trend()) -> DataFrame:
    """Trend metrics of the last bar on or before the as-of date."""
    m = with_trend_metrics(bars, t).select("ts_code", F.col("trade_date").alias("asof_date"), *TREND_COLUMNS)
    out = asof_join(candidates, m, "asof_date", "ts_code", bounded=True)
    return out.withColumn("trend_midlong_pass", holds(F.col("trend_midlong_pass")))


def trend_part(candidates: DataFrame, bars: DataFrame, t: Trend) -> Part:
    """As ``attach_trend``; candidates that came with the metrics of their last bar keep them."""
    if set(TREND_COLUMNS) <= set(candidates.columns):
        return Part([], [], lambda x: {}, {}, finish=lambda df: df.withColumn("trend_midlong_pass", holds(F.col("trend_midlong_pass"))))
    raw, options = [f"__{c}" for c in TREND_COLUMNS], asdict(t)
    held = [c for c in dict.fromkeys(f"ma_bfq_{n}" for n in (t.short_window, t.mid_window, t.long_window)) if c in bars.columns]

    def finish(df: DataFrame) -> DataFrame:
        found = dict(zip(TREND_COLUMNS, map(F.col, raw)))
        found["trend_data_date"] = F.date_from_unix_date(F.col("__trend_data_date").cast("int"))
        found["trend_midlong_pass"] = F.col("__trend_midlong_pass") == 1
        df = df.withColumns({f"{n}_right" if n in candidates.columns else n: c for n, c in found.items()}).drop(*raw)
        return df.withColumn("trend_midlong_pass", holds(F.col("trend_midlong_pass")))

    compute = mx.up_to_the_day(lambda b: dict(zip(raw[1:], mx.trend(b, options))), raw[0])
    return Part(["close", "high", "low", *held], raw, compute, finish=finish)


# ------------------------------------------------------------------ overhang


HISTOGRAM = "ts_code string, pos bigint, last_bin int, bin_low double, bin_high double, bins array<struct<bin:int,volume:double>>"


def price_histogram(positions: DataFrame, bars: DataFrame, lookback: int = 150, bins: int = 50) -> DataFrame:
    """Volume per equal-width close bin of the up to ``lookback`` bars ending at each (ts_code, pos), with the bin of the
    last close; one row per position, bins in order.

    A single price is padded on both sides; the top edge belongs to the last bin.  Positions of one block of bars meet
    that block's array once, and all their windows are views of it.
    """
    size = int(lookback)
    wanted = positions.where("pos is not null").select("ts_code", "pos").distinct().groupBy("ts_code", F.floor((F.col("pos") - 1) / size).alias("block"))
    blocks = wanted.agg(F.collect_list("pos").alias("pos")).join(block_bars(bars, size, ["close", "vol"]), ["ts_code", "block"])
    part = lambda c: F.transform("bars", lambda b: b[c].cast("double"))
    arrays = blocks.select("ts_code", "pos", block_start(F.col("block"), size).cast("bigint").alias("start"), part("close").alias("close"), part("vol").alias("vol"))

    def histograms(close: np.ndarray, vol: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Histograms of the windows that end at the given places of one run of bars (NaN: no close)."""
        view = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), x]), size)[ends]
        c, v = view(close), view(vol)
        some = ~np.isnan(c).all(axis=1)
        return {"ends": ends[some], **mx.histograms(c[some], v[some], bins)}

    def run(batches):
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                code, start = col["ts_code"][i].as_py(), col["start"][i].as_py()
                close, vol, pos = (col[n][i].values.to_numpy(zero_copy_only=False).astype(t) for n, t in (("close", float), ("vol", float), ("pos", np.int64)))
                h = histograms(close, vol, np.sort(pos) - start)
                n, used = len(h["ends"]), h["filled"]
                entry = pa.StructArray.from_arrays([pa.array(np.nonzero(used)[1].astype(np.int32)), pa.array(h["volume"][used])], ["bin", "volume"])
                edges = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * n, pa.string()), pa.array(h["ends"] + start), pa.array(h["last"].astype(np.int32)), pa.array(h["lo"]), pa.array(h["hi"]),
                     pa.ListArray.from_arrays(pa.array(edges), entry)],
                    ["ts_code", "pos", "last_bin", "bin_low", "bin_high", "bins"],
                )

    return arrays.mapInArrow(run, HISTOGRAM)


def overhang_ratio(hist: DataFrame) -> DataFrame:
    """Share of volume in bins above the current price, per (ts_code, pos)."""
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x["volume"])
    both = hist.select("ts_code", "pos", total("bins").alias("__all"), total(F.filter("bins", lambda x: x["bin"] > F.col("last_bin"))).alias("__above"))
    share = F.when(F.col("__all") > 0, clamp(F.col("__above") / F.col("__all"))).otherwise(F.lit(0.0))
    return both.select("ts_code", "pos", share.alias("overhang_ratio"))


def overhang_part(lookback: int = 150, bins: int = 50) -> Part:
    size, count = int(lookback), int(bins)
    return Part(["close", "vol"], ["overhang_ratio"], lambda x: {"overhang_ratio": mx.overhang(x, size, count)})


def attach_overhang(candidates: DataFrame, bars: DataFrame, lookback: int = 150, bins: int = 50) -> DataFrame:
    """Overhang per candidate over its last bars; 0 with no history up to the date, NULL for an unknown symbol."""
    return beside(candidates, bars, [overhang_part(lookback, bins)])


# ------------------------------------------------------------------ anchored metrics


@dataclass(frozen=True)
class PullbackSpan:
    anchor_date_col: str = "best_phase1_date"
    pre_window: int = 20
    burst_window: int = 2
    pullback_window: int = 5
    recent_window: int = 2


ANCHOR_FALLBACKS = ["best_phase1_date", "last_phase1_date", "first_phase1_date", "anchor_date"]


def anchor_of(df: DataFrame, preferred: str) -> Column:
    names = [c for c in [preferred, *ANCHOR_FALLBACKS] if c in df.columns]
    return F.coalesce(*[F.col(c).cast("date") for c in names]) if names else F.lit(None).cast("date")


def pullback_metrics(candidates: DataFrame, bars: DataFrame, p: PullbackSpan = PullbackSpan(), *, attach: bool = False) -> DataFrame:
    """Volume and range behaviour between a candidate's anchor bar and its as-of bar.

    A candidate looks up its two bars in its entity's bars and takes the bars before, after and between them by their places.
    With ``attach`` every candidate is returned with its metrics, else one row per key and anchor that has any.
    """
    if attach:
        return beside(candidates, bars, [pullback_part(candidates, p, attach=True)])
    rows = candidates.select(*KEYS, anchor_of(candidates, p.anchor_date_col).alias("phase2_anchor_date"))
    return beside(rows, bars, [pullback_part(rows, p)], distinct=True)


def pullback_part(candidates: DataFrame, p: PullbackSpan = PullbackSpan(), *, attach: bool = False) -> Part:
    own = {"phase2_anchor_date": anchor_of(candidates, p.anchor_date_col)} if attach else {}
    days = {"now": F.col("asof_date"), "anchor": F.when(F.col("asof_date").isNotNull(), F.least("phase2_anchor_date", "asof_date"))}
    raw = [
        "phase2_days_since_anchor", "phase2_pre_avg_volume", "phase2_burst_avg_volume", "phase2_pullback_avg_volume", "phase2_recent_avg_volume",
        "__down", "__up", "phase2_anchor_high", "phase2_anchor_low", "phase2_anchor_close", "phase2_post_anchor_high", "phase2_pullback_low",
        "phase2_current_close", "phase2_pullback_avg_range_pct", "__rh", "__rl",
    ]

    pre_window, burst_window, pullback_window, recent_window = p.pre_window, p.burst_window, p.pullback_window, p.recent_window

    def spans(x: Lookup) -> dict[str, Series]:
        high, low, close, vol = (x.bars[n] for n in ("high", "low", "close", "vol"))
        z, a = x.at("now"), x.at("anchor")
        some = (a >= 0) & (a < z)
        a, z = np.where(some, a, -1), np.where(some, z, -1)
        lag = close.lag(1)
        before = Series(lag.values, lag.known & (np.diff(x.entity, prepend=-1) == 0))
        both = close.known & before.known
        down = Series(vol.values, vol.known & both & (close.values < before.values))
        up = Series(vol.values, vol.known & both & (close.values >= before.values))
        share = Series((high.values - low.values) / np.where(close.values == 0, 1.0, close.values), high.known & low.known & close.known & (close.values != 0))
        last = lambda n: [(z - k, some & (z - k > a)) for k in range(n - 1, -1, -1)]
        pre = [(a - k, some & (a - k >= x.first)) for k in range(pre_window, 0, -1)]
        burst = [(a + k, some & (a + k <= z)) for k in range(burst_window)]
        tail, recent = last(pullback_window), last(recent_window)
        after = np.where(some, a + 1, -1)
        late = np.where(some, np.maximum(a, z - recent_window) + 1, -1)
        found = [
            Series((z - a).astype(float), some), x.mean(vol, pre), x.mean(vol, burst), x.mean(vol, tail), x.mean(vol, recent), x.mean(down, tail), x.mean(up, tail),
            x.get(high, a), x.get(low, a), x.get(close, a), x.extreme(high, a, z, 1), x.extreme(low, after, z, -1), x.get(close, z), x.mean(share, tail),
            x.extreme(high, late, z, 1), x.extreme(low, late, z, -1),
        ]
        return dict(zip(raw, found))

    def finish(g: DataFrame) -> DataFrame:
        g = (g if attach else g.where("phase2_days_since_anchor is not null")).withColumn("phase2_days_since_anchor", F.col("phase2_days_since_anchor").cast("int"))
        if attach:
            g = g.withColumn("phase2_anchor_date", F.when(F.col("phase2_days_since_anchor").isNotNull(), F.col("phase2_anchor_date")))
        c = F.col
        anchor_range = ratio(c("phase2_anchor_high") - c("phase2_anchor_low"), c("phase2_anchor_close"))
        return g.withColumns(
            {
                "phase2_pullback_volume_vs_pre": ratio(c("phase2_pullback_avg_volume"), c("phase2_pre_avg_volume")),
                "phase2_recent_volume_vs_pre": ratio(c("phase2_recent_avg_volume"), c("phase2_pre_avg_volume")),
                "phase2_pullback_volume_vs_burst": ratio(c("phase2_pullback_avg_volume"), c("phase2_burst_avg_volume")),
                "phase2_down_volume_pressure": ratio(c("__down"), c("__up")),
                "phase2_pullback_depth_pct": F.lit(1.0) - ratio(c("phase2_current_close"), c("phase2_post_anchor_high")),
                "phase2_close_to_anchor_close_pct": change(c("phase2_current_close"), c("phase2_anchor_close")),
                "phase2_low_to_anchor_low_pct": change(c("phase2_pullback_low"), c("phase2_anchor_low")),
                "phase2_chase_extension_pct": change(c("phase2_current_close"), c("phase2_anchor_high")),
                "phase2_anchor_range_pct": anchor_range,
                "phase2_range_contraction_ratio": ratio(c("phase2_pullback_avg_range_pct"), anchor_range),
                "phase2_recent_range_pct": ratio(c("__rh") - c("__rl"), c("phase2_current_close")),
            }
        ).drop("__down", "__up", "__rh", "__rl")

    return Part(["high", "low", "close", "vol"], raw, spans, days, own, finish)


def ensure_pullback_metrics(df: DataFrame, bars: DataFrame, p: PullbackSpan = PullbackSpan()) -> DataFrame:
    """Compute the pullback metrics once; a frame that has them is returned as it is."""
    if "phase2_pullback_volume_vs_pre" in df.columns:
        return df
    return pullback_metrics(df, bars, p, attach=True)


CHIP_COLUMNS = ["cost_5pct", "cost_15pct", "cost_50pct", "cost_85pct", "cost_95pct", "weight_avg", "winner_rate"]


def chip_structure(
    candidates: DataFrame, bars: DataFrame, pre_window: int = 60, near_pct: float = 0.03, anchor_date_col: str = "anchor_date", *, attach: bool = False
) -> DataFrame:
    """Cost-distribution fields of the latest bar that has any, and their means before and after the anchor.

    Running sums per entity give both means by difference, so a candidate looks up a few bars and not its whole span.
    With ``attach`` every candidate is returned with its fields, else one row per key and anchor.
    """
    part = chip_part(candidates, pre_window, near_pct, anchor_date_col)
    if attach:
        return beside(candidates, bars, [part])
    rows = candidates.select(*KEYS, part.own.pop("chip_anchor_date").alias("chip_anchor_date"))
    return beside(rows, bars, [part], distinct=True)


def chip_part(candidates: DataFrame, pre_window: int = 60, near_pct: float = 0.03, anchor_date_col: str = "anchor_date") -> Part:
    anchor = F.col(anchor_date_col).cast("date") if anchor_date_col in candidates.columns else F.lit(None).cast("date")
    # days before the anchor end one day earlier
    days = {"now": F.col("asof_date"), "before": F.date_sub("chip_anchor_date", 1)}
    raw = [
        "__day", "chip_current_close", *[f"chip_{n}" for n in CHIP_COLUMNS], "chip_price_vs_cost_50", "chip_price_vs_cost_85", "chip_price_vs_cost_95",
        "chip_price_vs_weight_avg", "chip_cost_band_width_15_85", "chip_cost_band_width_5_95", "chip_pre_weight_avg_mean", "chip_post_weight_avg_mean",
        "chip_center_shift", "chip_pre_winner_rate_mean", "chip_post_winner_rate_mean", "chip_winner_rate_change", "__near_cost", "__near_weight",
    ]

    def fields(x: Lookup) -> dict[str, Series]:
        z, a, has = x.at("now"), x.at("before"), x.row_days["before"].known
        some = x.bars["weight_avg"].known | x.bars["cost_50pct"].known | x.bars["winner_rate"].known
        latest = x.get(Series(x.last_known(some).astype(float), np.ones(len(some), bool)), z).values.astype(np.int64)
        chip = np.where((z >= 0) & (latest >= 0), latest, z)
        # sums up to just before the pre-anchor window, or before the trailing window when there is no anchor
        base = np.where(has, a, z)
        p = np.where((base >= 0) & (base - pre_window >= x.first), base - pre_window, -1)

        def means(name: str) -> tuple[Series, Series]:
            total, seen = x.running(x.bars[name])
            now_s, now_k, a_s, a_k, p_s, p_k = (x.get(s, at).filled(0.0) for at in (z, a, p) for s in (total, seen))
            n = a_k - p_k
            pre = Series((a_s - p_s) / np.where(n > 0, n, 1.0), has & (n > 0))
            n = now_k - np.where(has, a_k, p_k)
            return pre, Series((now_s - np.where(has, a_s, p_s)) / np.where(n > 0, n, 1.0), (z >= 0) & (n > 0))

        def moved(new: Series, old: Series) -> Series:
            known = new.known & old.known & (old.values != 0)
            return Series(new.values / np.where(known, old.values, 1.0) - 1.0, known)

        def near(v: Series) -> Series:
            inside = (v.values >= px.values * (1.0 - near_pct)) & (v.values <= px.values * (1.0 + near_pct))
            return Series((inside & v.known & px.known).astype(float), np.ones(len(z), bool))

        px, c = x.get(x.bars["close"], z), {n: x.get(x.bars[n], chip) for n in CHIP_COLUMNS}
        (pre_w, post_w), (pre_r, post_r) = means("weight_avg"), means("winner_rate")
        day = x.get(Series(x.day.astype(float), np.ones(len(some), bool)), chip)
        found = [
            day, px, *c.values(), *[moved(px, c[n]) for n in ("cost_50pct", "cost_85pct", "cost_95pct", "weight_avg")],
            moved(c["cost_85pct"], c["cost_15pct"]), moved(c["cost_95pct"], c["cost_5pct"]), pre_w, post_w, moved(post_w, pre_w),
            pre_r, post_r, Series(post_r.values - pre_r.values, pre_r.known & post_r.known), near(c["cost_50pct"]), near(c["weight_avg"]),
        ]
        return dict(zip(raw, found))

    def finish(now: DataFrame) -> DataFrame:
        kept = [c for c in now.columns if c not in raw]
        return now.select(
            *kept,
            F.date_from_unix_date(F.col("__day").cast("int")).alias("chip_data_date"),
            *raw[1:-2],
            (F.col("__near_cost") == 1).alias("chip_near_price_has_cost_50"),
            (F.col("__near_weight") == 1).alias("chip_near_price_has_weight_avg"),
        )

    return Part(["close", *CHIP_COLUMNS], raw, fields, days, {"chip_anchor_date": anchor}, finish)


# ------------------------------------------------------------------ near-high gate


@dataclass(frozen=True)
class NewHigh:
    rolling_window: int = 750
    min_periods: int = 250
    min_high_ratio: float = 0.90
    max_high_ratio: float = 1.30
    require_amount: bool = True
    avg_amount_window: int = 20
    min_avg_amount: float = 100_000_000.0
    enable_score_adjustment: bool = True
    breakout_ratio: float = 1.00
    ideal_min_ratio: float = 1.02
    ideal_max_ratio: float = 1.08
    far_ratio: float = 1.20
    pre_breakout_min_factor: float = 0.65
    pre_breakout_max_factor: float = 0.95
    ideal_factor: float = 1.25
    far_factor: float = 0.70
    very_far_factor: float = 0.45


def high_ratio_bands(r: Column, k: NewHigh) -> list[tuple[Column, str, tuple[float, float], tuple[float, float]]]:
    """Bands of close / previous high in order: test, reason, ends of the band and factors at its ends."""
    edges = [k.min_high_ratio, k.breakout_ratio, k.ideal_min_ratio, k.ideal_max_ratio, k.far_ratio, k.max_high_ratio]
    factors = [
        (k.pre_breakout_min_factor, k.pre_breakout_max_factor), (1.0, k.ideal_factor), (k.ideal_factor, k.ideal_factor),
        (k.ideal_factor, k.far_factor), (k.far_factor, k.very_far_factor),
    ]
    reasons = ["near_high_not_breakout", "fresh_breakout", "confirmed_breakout_ideal", "extended_breakout", "too_extended"]
    # the ideal band and those above it hold their upper end
    tests = [r < edges[1], r < edges[2], r <= edges[3], r <= edges[4], r.isNotNull()]
    return list(zip(tests, reasons, zip(edges, edges[1:]), factors))


def high_ratio_factor(r: Column, k: NewHigh) -> tuple[Column, Column]:
    """Factor, linear inside each band, and reason of the band that close / previous high lies in."""
    if not k.enable_score_adjustment:
        return F.lit(1.0), F.lit("disabled")
    band = F.lit(None).cast("struct<reason:string,factor:double>")
    for test, reason, ends, factors in reversed(high_ratio_bands(r, k)):
        band = F.when(test, F.struct(F.lit(reason).alias("reason"), F.greatest(F.lit(0.0), interpolate(r, *ends, *factors)).alias("factor"))).otherwise(band)
    return band["factor"], band["reason"]


NEW_HIGH_COLUMNS = [
    "new_high_review_pass", "new_high_review_reason", "high_3y_prev", "high_ratio_750", "distance_to_high_750", "avg_amount_20d",
    "new_high_score_factor", "new_high_score_reason",
]


def with_new_high(bars: DataFrame, k: NewHigh = NewHigh()) -> DataFrame:
    """Gate on the distance to the previous high and on liquidity, evaluated at every bar."""
    prev = BARS.high("high", k.rolling_window, lag=1, min_periods=1)
    df = bars.withColumns({"__rn": BARS.index(), "__prev": prev})
    if "amount" in bars.columns:
        df = df.withColumn("__amt", BARS.mean("amount", k.avg_amount_window, min_periods=1))
    enough = F.col("__rn") - 1 >= k.min_periods
    priced = enough & holds(F.col("close") > 0) & holds(F.col("__prev") > 0)
    df = df.withColumn("high_ratio_750", F.when(priced, F.col("close") / F.col("__prev")))
    r = F.col("high_ratio_750")
    factor, why = high_ratio_factor(r, k)
    in_band = holds((r >= k.min_high_ratio) & (r <= k.max_high_ratio))
    reason = (
        F.when(~enough, "insufficient_history")
        .when(r.isNull(), "invalid_price")
        .when(r < k.min_high_ratio, "high_ratio_below_min")
        .when(r > k.max_high_ratio, "high_ratio_above_max")
    )
    amount = F.lit(None).cast("double")
    if k.require_amount:
        if "amount" in bars.columns:
            amount = F.when(in_band, F.col("__amt"))
            reason = reason.when(F.col("__amt").isNull(), "invalid_amount").when(F.col("__amt") < k.min_avg_amount, "avg_amount_below_min")
        else:
            reason = reason.when(F.lit(True), "missing_amount")
    df = df.withColumns(
        {
            "high_3y_prev": F.when(priced, F.col("__prev")),
            "distance_to_high_750": F.lit(1.0) - r,
            "avg_amount_20d": amount,
            "new_high_score_factor": F.when(r.isNotNull(), factor),
            "new_high_score_reason": F.when(r.isNotNull(), why),
            "new_high_review_reason": reason.otherwise("pass"),
        }
    )
    return df.withColumn("new_high_review_pass", F.col("new_high_review_reason") == "pass").drop("__rn", "__prev", "__amt")


# ------------------------------------------------------------------ adjustments


@dataclass
class Stage:
    """One adjustment: which score it reads and writes, and its parameters."""

    name: str
    params: dict = field(default_factory=dict)

    def get(self, key: str, default):
        v = self.params
        for part in key.split("."):
            if not isinstance(v, dict) or part not in v:
                return default
            v = v[part]
        return type(default)(v) if default is not None and not isinstance(default, bool) else v


def _rescore(df: DataFrame, s: Stage, factor: Column, name: str, default_score: str, default_out: str | None = None, **extra: Column) -> DataFrame:
    score = s.get("score_col", default_score)
    out = s.get("output_score_col", default_out or score)
    if score not in df.columns:
        raise ValueError(f"{s.name}: score column not found: {score}")
    df = df.withColumns({name: factor, **extra})
    return df.withColumn(out, F.col(score).cast("double") * F.col(name))


def _runup(df, s):
    raw = sigmoid_decay(F.col(_runup_name(s)), s.get("threshold", 0.35), s.get("sharpness", 20.0))
    w = s.get("weight", 1.0)
    return _rescore(df, s, toward_neutral(raw, w), "runup_penalty_factor", "baseline_score", "adjusted_score", runup_penalty_raw_factor=raw)


def _runup_name(s: Stage) -> str:
    return s.get("runup_col", f"runup_{s.get('window', 150)}")


def _volume_names(s: Stage) -> tuple[str, str]:
    ratio_name = f"volume_ratio_{s.get('short_window', 3)}d_{s.get('ma_window', 20)}"
    return s.get("ratio_col", ratio_name), s.get("streak_col", "volume_spike_streak")


def _volume(df, s):
    rc, sc = _volume_names(s)
    boost = sigmoid_boost(F.col(rc), s.get("strength.threshold", 1.8), s.get("strength.sharpness", 3.0), s.get("strength.max_boost", 0.15))
    decay = sigmoid_decay(F.col(sc), s.get("streak.threshold", 3.0), s.get("streak.sharpness", 1.5))
    factor = toward_neutral(boost * decay, s.get("weight", 1.0))
    return _rescore(df, s, factor, s.get("factor_col", "volume_penalty_factor"), "adjusted_score")


def _burst(df, s):
    rise = lambda c, t, sharp: sigmoid_rise(F.col(c), t, sharp)
    rs, vs = s.get("ret_sharpness", 25.0), s.get("volume_sharpness", 1.4)
    price = F.greatest(rise("burst_ret_1d", s.get("min_ret_1d", 0.12), rs), rise("burst_ret_2d", s.get("min_ret_2d", 0.16), rs))
    volume = F.greatest(
        rise("burst_volume_ratio_1d", s.get("min_volume_ratio_1d", 4.0), vs), rise("burst_volume_ratio_2d", s.get("min_volume_ratio_2d", 3.0), vs)
    )
    amount = rise("burst_amount_ratio_1d", s.get("min_amount_ratio_1d", 3.5), s.get("amount_sharpness", 1.3))
    breakout = rise("burst_breakout_pct", s.get("min_breakout_pct", -0.01), s.get("breakout_sharpness", 80.0))
    position = rise("burst_close_position", s.get("min_close_position", 0.75), s.get("close_position_sharpness", 8.0))
    total = price * 0.30 + volume * 0.30 + amount * 0.15 + breakout * 0.15 + position * 0.10
    factor = scale_factor(total, s.get("min_factor", 1.0), s.get("max_factor", 1.45))
    return _rescore(
        df, s, factor, s.get("factor_col", "burst_strength_factor"), "adjusted_score",
        burst_strength_price_score=price, burst_strength_volume_score=volume, burst_strength_score=total,
    )


def _stability(df, s):
    gap = sigmoid_decay(F.col("base_ma_gap_l2"), s.get("ma_gap.threshold", 0.04), s.get("ma_gap.sharpness", 80.0))
    trend = sigmoid_decay(F.col("base_ma60_trend_abs"), s.get("ma_trend.threshold", 0.08), s.get("ma_trend.sharpness", 25.0))
    return _rescore(df, s, gap * trend, s.get("factor_col", "base_stability_factor"), "adjusted_score")


def _box(df, s):
    lo, hi = s.get("min_factor", 0.3), s.get("max_factor", 1.2)
    strength = sigmoid_boost(F.col("box_breakout_pct"), s.get("strength.threshold", -0.01), s.get("strength.sharpness", 80.0), 1.0, 0.0)
    # a missing metric gives strength 0, hence -1 after the shift: kept as it is
    raw = F.lit(lo) + F.lit(hi - lo) * (strength - 1.0)
    return _rescore(df, s, toward_neutral(raw, s.get("weight", 1.0)), s.get("factor_col", "box_breakout_factor"), "adjusted_score", box_breakout_raw_factor=raw)


def overhang_factor(r: Column, threshold: float = 0.35, sharpness: float = 12.0, low: float = 0.4, high: float = 1.0) -> Column:
    return F.when(r.isNull(), F.lit(float(high))).otherwise(F.lit(float(low)) + F.lit(float(high - low)) * sigmoid_decay(r, threshold, sharpness))


def _overhang(df, s):
    f = overhang_factor(F.col("overhang_ratio"), s.get("threshold", 0.35), s.get("sharpness", 12.0), s.get("min_factor", 0.4), s.get("max_factor", 1.0))
    return _rescore(df, s, f, s.get("factor_col", "overhang_factor"), "adjusted_score")


def _trend(df, s):
    t = s.get("threshold", s.get("min_mid_ma_slope", 0.0))
    rise = sigmoid_rise(F.col(s.get("slope_col", "trend_mid_ma_slope")), t, s.get("sharpness", 80.0))
    lo, hi = s.get("min_factor", 0.25), s.get("max_factor", 1.35)
    factor = F.lit(lo) + F.lit(hi - lo) * rise
    if not s.get("score_col", ""):
        return df.withColumn(s.get("factor_col", "trend_ma_factor"), factor)
    return _rescore(df, s, factor, s.get("factor_col", "trend_ma_factor"), "")


def _volume_hold(df, s):
    hold = sigmoid_rise(F.col("phase2_pullback_volume_vs_pre"), s.get("min_pullback_vs_pre", 1.6), s.get("hold_sharpness", 3.0))
    recent = sigmoid_rise(F.col("phase2_recent_volume_vs_pre"), s.get("min_recent_vs_pre", 1.3), s.get("recent_sharpness", 3.0))
    cool = sigmoid_decay(F.col("phase2_pullback_volume_vs_burst"), s.get("max_pullback_vs_burst", 1.05), s.get("burst_cool_sharpness", 4.0), 0.5)
    down = sigmoid_decay(F.col("phase2_down_volume_pressure"), s.get("max_down_volume_pressure", 1.5), s.get("down_pressure_sharpness", 3.0), 0.7)
    total = hold * 0.55 + recent * 0.25 + cool * 0.10 + down * 0.10
    factor = scale_factor(total, s.get("min_factor", 0.35), s.get("max_factor", 1.35))
    return _rescore(df, s, factor, s.get("factor_col", "phase2_volume_hold_factor"), "phase2_score_mean", phase2_volume_hold_score=total)


def _compact(df, s):
    depth = F.col("phase2_pullback_depth_pct")
    shallow = sigmoid_decay(depth, s.get("max_depth", 0.14), s.get("depth_sharpness", 40.0), 0.0)
    enough = sigmoid_rise(depth, s.get("min_depth", 0.0), s.get("min_depth_sharpness", 60.0))
    whole = sigmoid_rise(F.col("phase2_low_to_anchor_low_pct"), -s.get("max_low_below_anchor_low", 0.06), s.get("breakdown_sharpness", 50.0))
    tight = sigmoid_decay(F.col("phase2_range_contraction_ratio"), s.get("max_range_contraction", 0.95), s.get("range_sharpness", 8.0), 0.0)
    calm = sigmoid_decay(F.col("phase2_recent_range_pct"), s.get("max_recent_range_pct", 0.12), s.get("recent_range_sharpness", 35.0), 0.0)
    no_chase = sigmoid_decay(F.col("phase2_chase_extension_pct"), s.get("max_chase_extension_pct", 0.12), s.get("chase_sharpness", 35.0), 0.5)
    total = shallow * 0.25 + enough * 0.10 + whole * 0.25 + tight * 0.20 + calm * 0.10 + no_chase * 0.10
    factor = scale_factor(total, s.get("min_factor", 0.45), s.get("max_factor", 1.25))
    return _rescore(df, s, factor, s.get("factor_col", "phase2_pullback_compact_factor"), "phase2_score_mean", phase2_pullback_compact_score=total)


ORDER = [
    "runup", "volume", "burst_strength", "base_stability", "box_breakout", "overhang", "chip_structure", "midlong_trend",
    "phase2_volume_hold", "phase2_pullback_compact",
]
RESCORE: dict[str, Callable[[DataFrame, Stage], DataFrame]] = {
    "runup": _runup, "volume": _volume, "burst_strength": _burst, "base_stability": _stability, "box_breakout": _box,
    "overhang": _overhang, "midlong_trend": _trend, "phase2_volume_hold": _volume_hold, "phase2_pullback_compact": _compact,
}


def enabled_stages(config: dict) -> list[Stage]:
    return [Stage(n, config[n]) for n in ORDER if isinstance(config.get(n), dict) and config[n].get("enabled", False)]


def trend_of(s: Stage) -> Trend:
    d = Trend()
    return Trend(**{f: s.get(f, getattr(d, f)) for f in d.__dataclass_fields__})


def apply_adjustments(candidates: DataFrame, bars: DataFrame, config: dict) -> DataFrame:
    """Apply the enabled stages in their fixed order.

    The metrics of all stages come from one pass beside the bars, in one shuffle; metrics that candidates bring along are
    not looked up again.
    """
    stages = {s.name: s for s in enabled_stages(config)}
    parts = []
    for name, part in (("runup", _runup_part), ("burst_strength", _burst_part), ("box_breakout", _box_part), ("base_stability", _stability_part), ("volume", _volume_part)):
        if name in stages:
            parts.append(part(stages[name]))
    if "overhang" in stages:
        parts.append(overhang_part(stages["overhang"].get("lookback", 150), stages["overhang"].get("n_bins", 50)))
    if "chip_structure" in stages:
        s = stages["chip_structure"]
        parts.append(chip_part(candidates, s.get("pre_window", 60), s.get("near_pct", 0.03), s.get("anchor_date_col", "anchor_date")))
    if "midlong_trend" in stages:
        parts.append(trend_part(candidates, bars, trend_of(stages["midlong_trend"])))
    pullback = [s for n, s in stages.items() if n.startswith("phase2_")]
    if pullback and "phase2_pullback_volume_vs_pre" not in candidates.columns:
        d = PullbackSpan()
        span = PullbackSpan(**{f: pullback[0].get(f, getattr(d, f)) for f in d.__dataclass_fields__})
        parts.append(pullback_part(candidates, span, attach=True))
    if any(p.outputs for p in parts):
        df = beside(candidates, bars, parts)
    else:
        df = candidates
        for p in parts:
            df = p.finish(df)
    for name, s in stages.items():
        if name in RESCORE:
            df = RESCORE[name](df, s)
    return df


def _runup_part(s: Stage) -> Part:
    name, window = _runup_name(s), s.get("window", 150)
    return Part(["close"], [name], mx.on_the_day(lambda b: {name: mx.runup(b, window)}))


def _burst_part(s: Stage) -> Part:
    names, spans = BURST_COLUMNS, (s.get("volume_window", 20), s.get("recent_high_window", 30))
    return Part(["high", "low", "close", "vol", "amount"], names, mx.on_the_day(lambda b: dict(zip(names, mx.burst(b, *spans)))))


def _box_part(s: Stage) -> Part:
    window, high, close = s.get("window", 60), s.get("high_col", "high"), s.get("close_col", "close")
    names = ["box_high", "box_breakout_pct"]
    return Part([high, close], names, mx.on_the_day(lambda b: dict(zip(names, mx.box(b[high], b[close], window)))))


def _stability_part(s: Stage) -> Part:
    w, fast, slow = s.get("window", 60), s.get("fast_ma_col", "ma_bfq_20"), s.get("slow_ma_col", "ma_bfq_60")
    trend, lag = s.get("trend_ma_col", slow), s.get("ma_trend.prior_lag", w * 2)
    weights = s.get("ma_trend.recent_weight", 0.7), s.get("ma_trend.prior_weight", 0.3)
    names = ["base_ma_gap_l2", "base_ma60_recent_slope_pct", "base_ma60_prior_slope_pct", "base_ma60_trend_abs"]
    compute = mx.on_the_day(lambda b: dict(zip(names, mx.base_stability(b[fast], b[slow], b[trend], w, lag, *weights))))
    return Part([fast, slow, trend], names, compute)


def _volume_part(s: Stage) -> Part:
    names, spans = list(_volume_names(s)), (s.get("ma_window", 20), s.get("short_window", 3))
    spike = s.get("streak.spike_ratio", s.get("strength.threshold", 1.8))
    compute = mx.on_the_day(lambda b: dict(zip(names, mx.volume(b, *spans, spike))))
    return Part(["vol"], names, compute, finish=lambda df: df.withColumn(names[1], F.col(names[1]).cast("bigint")))


PRESETS: dict[str, dict] = {
    "ma120_trend_soft": {
        "midlong_trend": {
            "enabled": True, "short_window": 20, "mid_window": 120, "long_window": 250, "slope_lag": 60, "return_window": 120,
            "position_window": 120, "min_return": 0.0, "min_mid_ma_slope": 0.0, "min_position": 0.45, "require_above_mid_ma": True,
            "threshold": 0.0, "sharpness": 80, "min_factor": 0.25, "max_factor": 1.75, "score_col": "phase2_score_mean",
            "output_score_col": "adjusted_phase2_score",
        }
    }
}


def reviewer_config(name_or_mapping: str | dict | None) -> dict:
    """Adjustment config by preset name or mapping; empty, 'none' and 'default' mean no adjustment."""
    if name_or_mapping in (None, "", "none", "default"):
        return {}
    if isinstance(name_or_mapping, dict):
        inner = name_or_mapping.get("post_penalties", name_or_mapping)
        return inner if isinstance(inner, dict) else {}
    if name_or_mapping not in PRESETS:
        raise ValueError(f"unknown reviewer: {name_or_mapping}")
    return PRESETS[name_or_mapping]


__all__ = ["apply_adjustments", "history_window", "reviewer_config"]
