"""Review metrics in numpy: of the bars of one entity, and of candidates that look their entity's bars up.

They have the values of the window expressions in ``review``, to the last bit.  Bars and candidates need one shuffle for any
number of them (``rolling.beside_bars``), where a join per group of metrics moves all candidates anew.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

from barloom.functions.rolling import Lookup, Series

# workers get this module with the functions that use it: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Bars = dict[str, Series]


def ratio(num: Series, den: Series) -> Series:
    known = num.known & den.known & (den.values != 0)
    return Series(num.values / np.where(known, den.values, 1.0), known)


def change(num: Series, den: Series) -> Series:
    part = ratio(num, den)
    return Series(part.values - 1.0, part.known)


def minus(a: Series, b: Series) -> Series:
    return Series(a.values - b.values, a.known & b.known)


def non_zero(x: Series) -> Series:
    return Series(x.values, x.known & (x.values != 0))


def at_least(x: Series, bound: float) -> np.ndarray:
    return x.known & (x.values >= bound)


def every(values: np.ndarray) -> Series:
    return Series(values.astype(float), np.ones(len(values), bool))


# ------------------------------------------------------------------ bars of one entity


def runup(b: Bars, window: int) -> Series:
    return change(b["close"], b["close"].low(window))


def volume(b: Bars, ma_window: int, short_window: int, spike_ratio: float) -> tuple[Series, Series]:
    """Short mean against the mean of earlier days, and the length of the current run of spike days."""
    vol = b["vol"]
    base = vol.mean(ma_window, lag=1)
    spike, place = at_least(ratio(vol, base), spike_ratio), np.arange(len(vol))
    calm = np.maximum.accumulate(np.where(spike, -1, place)) if len(vol) else place
    return ratio(vol.mean(short_window), base), every(np.where(spike, place - calm, 0))


def burst(b: Bars, volume_window: int, recent_high_window: int) -> list[Series]:
    c, vol, amount = b["close"], b["vol"], b["amount"]
    vb, ab = vol.mean(volume_window, lag=1), amount.mean(volume_window, lag=1)
    high = non_zero(b["high"].high(recent_high_window, lag=1, min_periods=1))
    return [
        c.change(1), c.change(2), ratio(vol, vb), ratio(vol.mean(2), vb), ratio(amount, ab), ratio(amount.mean(2), ab), high, change(c, high),
        ratio(minus(c, b["low"]), minus(b["high"], b["low"])),
    ]


def base_stability(fast: Series, slow: Series, trend: Series, window: int, prior_lag: int, recent_weight: float, prior_weight: float) -> list[Series]:
    """Root mean square of the lagged gap between two means, and the slopes of a trend mean before the trigger bar."""
    gap, trend = ratio(minus(fast, slow), slow), non_zero(trend)
    mean = Series(gap.values * gap.values, gap.known).mean(window, lag=1)
    t1, t2, t3 = (trend.lag(n) for n in (1, window + 1, prior_lag + 1))
    recent, prior = change(t1, t2), change(t2, t3)
    both = recent_weight * np.abs(recent.values) + prior_weight * np.abs(prior.values)
    return [Series(np.sqrt(mean.values), mean.known), recent, prior, Series(both, recent.known & prior.known)]


def box(high: Series, close: Series, window: int) -> list[Series]:
    top = non_zero(high.high(window, lag=1))
    return [top, change(close, top)]


def trend(b: Bars, t: dict) -> list[Series]:
    """Stored means where present, rolling means otherwise; price against them, slopes, return, range position and their score."""
    c = b["close"]

    def mean(n: int) -> Series:
        rolled, held = c.mean(n), b.get(f"ma_bfq_{n}")
        return rolled if held is None else Series(np.where(held.known, held.values, rolled.values), held.known | rolled.known)

    short, mid, long = (mean(t[f"{n}_window"]) for n in ("short", "mid", "long"))
    hi, lo = b["high"].high(t["position_window"], min_periods=1), b["low"].low(t["position_window"], min_periods=1)
    vs_mid, vs_long = change(c, mid), change(c, long)
    mid_slope, long_slope = mid.change(t["slope_lag"]), long.change(t["slope_lag"])
    gain, position = c.change(t["return_window"]), ratio(minus(c, lo), minus(hi, lo))
    flags = [at_least(gain, t["min_return"]), at_least(mid_slope, t["min_mid_ma_slope"]), at_least(position, t["min_position"])]
    if t["require_above_mid_ma"]:
        flags.append(at_least(vs_mid, 0.0))
    passed = np.sum(flags, axis=0)
    return [c, short, mid, long, vs_mid, vs_long, mid_slope, long_slope, gain, position, every(passed / float(len(flags))), every(passed == len(flags))]


# ------------------------------------------------------------------ candidates


def on_the_day(metrics: Callable[[Bars], Bars]) -> Callable[[Lookup], Bars]:
    """Metrics of the bar on a candidate's date; unknown without one."""

    def compute(x: Lookup) -> Bars:
        at = x.on("now")
        return {n: x.get(s, at) for n, s in x.each(metrics).items()}

    return compute


def up_to_the_day(metrics: Callable[[Bars], Bars], day: str) -> Callable[[Lookup], Bars]:
    """Metrics of the last bar on or before a candidate's date, and that bar's date."""

    def compute(x: Lookup) -> Bars:
        at = x.at("now")
        return {day: x.get(every(x.day), at), **{n: x.get(s, at) for n, s in x.each(metrics).items()}}

    return compute


def histograms(c: np.ndarray, v: np.ndarray, bins: int) -> dict[str, np.ndarray]:
    """Volume per equal-width close bin of windows (one per row, NaN: no close); every window has a close."""
    known = ~np.isnan(c)
    lo, hi = np.where(known, c, np.inf).min(axis=1), np.where(known, c, -np.inf).max(axis=1)
    pad = np.where(lo == hi, np.maximum(np.abs(lo) * 0.001, 0.01), 0.0)
    lo, hi = lo - pad, hi + pad
    k = np.floor((c - lo[:, None]) / (hi - lo)[:, None] * bins)
    k = np.where(known, np.clip(k, 0, bins - 1), 0).astype(np.int64)
    rows = np.arange(len(c))
    last = k[rows, c.shape[1] - 1 - np.argmax(known[:, ::-1], axis=1)]
    at = (k + rows[:, None] * bins)[known]
    volume = np.bincount(at, np.maximum(np.nan_to_num(v[known]), 0.0), len(c) * bins)
    return {"last": last, "lo": lo, "hi": hi, "volume": volume.reshape(-1, bins), "filled": np.bincount(at, minlength=len(c) * bins).reshape(-1, bins) > 0}


def overhang(x: Lookup, lookback: int, bins: int, at_once: int = 4096) -> Series:
    """Share of volume in bins above the current price over a candidate's last bars; 0 with no history, unknown without bars."""
    c, v = (np.where(s.known, s.values, np.nan) for s in (x.bars["close"], x.bars["vol"]))
    ends, back = np.unique(x.at("now"), return_inverse=True)
    share = np.zeros(len(ends))
    for start in range(0, len(ends), at_once):
        mine = np.arange(start, min(start + at_once, len(ends)))
        mine = mine[ends[mine] >= 0]
        at = ends[mine][:, None] + np.arange(1 - lookback, 1)
        inside = at >= np.searchsorted(x.entity, x.entity[ends[mine]], "left")[:, None]
        at = np.where(inside, at, 0)
        close, vol = np.where(inside, c[at], np.nan), v[at]
        some = ~np.isnan(close).all(axis=1)
        h = histograms(close[some], vol[some], bins)
        total, above = np.zeros(int(some.sum())), np.zeros(int(some.sum()))
        for k in range(bins):
            total += h["volume"][:, k]
            above += np.where(k > h["last"], h["volume"][:, k], 0.0)
        share[mine[some]] = np.where(total > 0, np.clip(above / np.where(total > 0, total, 1.0), 0.0, 1.0), 0.0)
    return Series(share[back.reshape(-1)], x.present())
