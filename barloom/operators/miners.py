"""Threshold miners: each is a set of weighted conditions over window columns.

All miners that run together share one window stage: the columns they need are collected by name in a ``Panel``, so a
column used by several miners is computed once and every window uses the same exchange and sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.cols import change, flags_text, holds, non_zero, number_flag, ratio, sample_id
from barloom.functions.windows import BARS

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("ts_code", T.StringType()),
        T.StructField("asof_date", T.DateType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("miner_name", T.StringType()),
        T.StructField("candidate_score", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("ret_1d", T.DoubleType()),
        T.StructField("ret_3d", T.DoubleType()),
        T.StructField("vol_ratio_1d", T.DoubleType()),
        T.StructField("vol_ratio_3d", T.DoubleType()),
        T.StructField("base_window_days", T.IntegerType()),
        T.StructField("base_range_pct", T.DoubleType()),
        T.StructField("breakout_flag", T.BooleanType()),
        T.StructField("rule_flags", T.StringType()),
    ]
)


class Panel:
    """Named window columns in dependency levels; one projection per level."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = [{}, {}, {}, {}]

    def put(self, level: int, name: str, expr: Column) -> Column:
        self.levels[level].setdefault(name, expr)
        return F.col(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            if level:
                df = df.withColumns(level)
        return df

    def ret(self, n: int) -> Column:
        """Change over n rows of the last known close."""
        self.put(0, "_cf", BARS.filled("close"))
        return self.put(1, f"_r{n}", BARS.pct("_cf", n))

    def high(self, c: str, n: int, lag: int = 0) -> Column:
        return self.put(1, f"_hi_{c}_{n}_{lag}", BARS.high(c, n, lag=lag))

    def low(self, c: str, n: int, lag: int = 0) -> Column:
        return self.put(1, f"_lo_{c}_{n}_{lag}", BARS.low(c, n, lag=lag))

    def mean(self, c: str, n: int, lag: int = 0) -> Column:
        return self.put(1, f"_ma_{c}_{n}_{lag}", BARS.mean(c, n, lag=lag))

    def slope(self, c: str, n: int, lag: int) -> Column:
        self.mean(c, n)
        return self.put(2, f"_sl_{c}_{n}_{lag}", BARS.pct(f"_ma_{c}_{n}_0", lag))

    def bars(self) -> Column:
        return self.put(0, "_bars", BARS.bars())


@dataclass
class Rule:
    name: str
    cond: Column
    weight: int = 1
    required: bool = False
    shown: bool = True


@dataclass
class Spec:
    rules: list[Rule]
    min_rows: int
    window: int
    label: int | None = 0
    base_range: Column | None = None
    vol_1d: Column | None = None
    vol_3d: Column | None = None
    breakout: Column | None = None
    extra: Column | None = None
    numbers: list[Column] = field(default_factory=list)


@dataclass
class MinerConfig:
    min_history: int = 80
    min_candidate_score: int = 4
    top_n_per_symbol: int = 5
    max_candidates_total: int = 8000

    @classmethod
    def from_dict(cls, data: dict | None):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (data or {}).items() if k in known})


def _spread(hi: Column, lo: Column) -> Column:
    return ratio(hi - lo, lo)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


@dataclass
class TypeN(MinerConfig):
    top_n_per_symbol: int = 10
    max_candidates_total: int = 0
    lookback_window: int = 60
    max_base_range_pct: float = 0.25
    min_ret_1d: float = 0.02
    min_ret_3d: float = 0.05
    min_vol_ratio_1d: float = 1.5
    min_vol_ratio_3d: float = 1.3
    breakout_tolerance: float = 0.01
    require_base_condition: bool = True
    enable_runup_rule: bool = False
    runup_window: int = 150
    max_runup_pct: float = 0.6
    runup_score_weight: int = 0


def runup_pct(p: Panel, window: int) -> Column:
    """Rise of the close over the lowest close of the window."""
    return change(F.col("close"), non_zero(p.low("close", window)))


def type_n(c: TypeN, p: Panel) -> Spec:
    n = c.lookback_window
    top, bottom = p.high("close", n, 1), p.low("close", n, 1)
    vol_1d = ratio(F.col("vol"), p.mean("vol", n, 1))
    vol_3d = ratio(p.mean("vol", 3), p.mean("vol", n, 1))
    base, brk = _spread(top, bottom), F.col("close") >= top * (1 - c.breakout_tolerance)
    rules = [
        Rule("base_ok", base <= c.max_base_range_pct, 2, c.require_base_condition),
        Rule("ret_1d_ok", p.ret(1) >= c.min_ret_1d),
        Rule("ret_3d_ok", p.ret(3) >= c.min_ret_3d),
        Rule("vol_1d_ok", vol_1d >= c.min_vol_ratio_1d),
        Rule("vol_3d_ok", vol_3d >= c.min_vol_ratio_3d),
        Rule("breakout_ok", brk),
    ]
    if c.enable_runup_rule:
        ok = runup_pct(p, c.runup_window) <= c.max_runup_pct
        rules.append(Rule("runup_ok", ok, max(c.runup_score_weight, 0), True))
    return Spec(rules, max(c.min_history, n + 3), n, None, base, vol_1d, vol_3d, brk)


@dataclass
class DowntrendSimple(MinerConfig):
    lookback_window: int = 60
    max_ret_20d: float = -0.08
    max_ret_60d: float = -0.15
    max_ret_3d: float = 0.02
    ma_window: int = 20
    ma_gap_threshold: float = 0.03


def downtrend_simple(c: DowntrendSimple, p: Panel) -> Spec:
    ma = p.mean("close", c.ma_window)
    rules = [
        Rule("down_20d", p.ret(20) <= c.max_ret_20d),
        Rule("down_60d", p.ret(60) <= c.max_ret_60d, 2),
        Rule("weak_rebound", p.ret(3) <= c.max_ret_3d),
        Rule("below_ma", ratio(ma - F.col("close"), ma) >= c.ma_gap_threshold),
    ]
    return Spec(rules, max(c.min_history, c.lookback_window), c.lookback_window)


@dataclass
class WeakSideways(MinerConfig):
    lookback_window: int = 60
    max_base_range_pct: float = 0.12
    max_abs_ret_3d: float = 0.02
    max_abs_ret_20d: float = 0.04
    max_vol_ratio_3d: float = 1.05


def weak_sideways(c: WeakSideways, p: Panel) -> Spec:
    n = c.lookback_window
    base = _spread(p.high("close", n), p.low("close", n))
    vol_3d = ratio(p.mean("vol", 3), p.mean("vol", n))
    rules = [
        Rule("tight_range", base <= c.max_base_range_pct, 2),
        Rule("flat_3d", F.abs(p.ret(3)) <= c.max_abs_ret_3d),
        Rule("flat_20d", F.abs(p.ret(20)) <= c.max_abs_ret_20d),
        Rule("quiet_vol", _zero(vol_3d) <= c.max_vol_ratio_3d),
    ]
    return Spec(rules, max(c.min_history, n), n, base_range=base, vol_3d=vol_3d)


@dataclass
class HighVolatilityRange(MinerConfig):
    lookback_window: int = 60
    min_base_range_pct: float = 0.35
    min_avg_intraday_range: float = 0.04
    max_abs_ret_20d: float = 0.10


def high_volatility_range(c: HighVolatilityRange, p: Panel) -> Spec:
    n = c.lookback_window
    base = _spread(p.high("close", n), p.low("close", n))
    p.put(0, "_span", ratio(F.col("high") - F.col("low"), F.col("close")))
    rules = [
        Rule("wide_range", base >= c.min_base_range_pct, 2),
        Rule("noisy_range", p.mean("_span", 20) >= c.min_avg_intraday_range, 2),
        Rule("non_trend", F.abs(p.ret(20)) <= c.max_abs_ret_20d),
    ]
    return Spec(rules, max(c.min_history, n), n, base_range=base)


@dataclass
class FakeBreakout(MinerConfig):
    min_history: int = 90
    min_candidate_score: int = 5
    lookback_window: int = 60
    max_base_range_pct: float = 0.25
    min_ret_1d: float = 0.02
    min_ret_3d: float = 0.05
    min_vol_ratio_1d: float = 1.5
    breakout_tolerance: float = 0.01
    future_window: int = 5
    max_future_ret: float = 0.02


def fake_breakout(c: FakeBreakout, p: Panel) -> Spec:
    n, m = c.lookback_window, c.future_window
    top, bottom = p.high("close", n, 1), p.low("close", n, 1)
    base, brk = _spread(top, bottom), F.col("close") >= top * (1 - c.breakout_tolerance)
    vol_1d = ratio(F.col("vol"), p.mean("vol", n, 1))
    # the look-ahead frame ends one row after the current one
    ahead = p.high("close", m, -1)
    rules = [
        Rule("base_ok", base <= c.max_base_range_pct),
        Rule("ret_1d_ok", p.ret(1) >= c.min_ret_1d),
        Rule("ret_3d_ok", p.ret(3) >= c.min_ret_3d),
        Rule("vol_ok", _zero(vol_1d) >= c.min_vol_ratio_1d),
        Rule("breakout_ok", brk),
        Rule("fail_follow_through", _zero(ratio(ahead - F.col("close"), F.col("close"))) <= c.max_future_ret, 1, True),
    ]
    return Spec(rules, max(c.min_history, n + m), n, base_range=base, vol_1d=vol_1d, breakout=brk)


@dataclass
class DowntrendRebound(MinerConfig):
    lookback_window: int = 60
    max_ret_60d: float = -0.12
    min_ret_3d: float = 0.04
    max_ret_20d: float = -0.03
    min_ma_gap: float = 0.02


def downtrend_rebound(c: DowntrendRebound, p: Panel) -> Spec:
    ma = p.mean("close", 20)
    rules = [
        Rule("trend_down", p.ret(60) <= c.max_ret_60d, 2, True),
        Rule("rebound_up", p.ret(3) >= c.min_ret_3d, 1, True),
        Rule("still_weak", p.ret(20) <= c.max_ret_20d),
        Rule("below_ma", ratio(ma - F.col("close"), ma) >= c.min_ma_gap),
    ]
    return Spec(rules, max(c.min_history, c.lookback_window), c.lookback_window)


@dataclass
class LateStageAcceleration(MinerConfig):
    lookback_window: int = 60
    min_ret_60d: float = 0.30
    min_ret_20d: float = 0.10
    min_ret_3d: float = 0.05
    breakout_tolerance: float = 0.02
    max_base_range_pct: float = 0.45


def late_stage_acceleration(c: LateStageAcceleration, p: Panel) -> Spec:
    n = c.lookback_window
    top = p.high("close", n)
    base, brk = _spread(top, p.low("close", n)), F.col("close") >= top * (1 - c.breakout_tolerance)
    rules = [
        Rule("long_up", p.ret(60) >= c.min_ret_60d, 2, True),
        Rule("medium_up", p.ret(20) >= c.min_ret_20d),
        Rule("short_accel", p.ret(3) >= c.min_ret_3d, 1, True),
        Rule("breakout_ok", brk),
        Rule("already_extended", base >= c.max_base_range_pct),
    ]
    return Spec(rules, max(c.min_history, n), n, base_range=base, breakout=brk)


@dataclass
class VolumeOnlySpike(MinerConfig):
    lookback_window: int = 60
    min_vol_ratio_1d: float = 2.5
    min_vol_ratio_3d: float = 1.8
    max_abs_ret_1d: float = 0.02
    max_ret_3d: float = 0.03
    breakout_tolerance: float = 0.01


def volume_only_spike(c: VolumeOnlySpike, p: Panel) -> Spec:
    n = c.lookback_window
    brk = F.col("close") >= p.high("close", n, 1) * (1 - c.breakout_tolerance)
    vol_1d = ratio(F.col("vol"), p.mean("vol", n, 1))
    vol_3d = ratio(p.mean("vol", 3), p.mean("vol", n, 1))
    rules = [
        Rule("spike_1d", _zero(vol_1d) >= c.min_vol_ratio_1d, 1, True),
        Rule("spike_3d", _zero(vol_3d) >= c.min_vol_ratio_3d),
        Rule("weak_price_1d", F.abs(p.ret(1)) <= c.max_abs_ret_1d),
        Rule("weak_price_3d", p.ret(3) <= c.max_ret_3d),
        Rule("no_breakout", ~holds(brk), 1, True),
    ]
    return Spec(rules, max(c.min_history, n), n, vol_1d=vol_1d, vol_3d=vol_3d, breakout=brk)


@dataclass
class BottomRebound(MinerConfig):
    min_history: int = 180
    min_candidate_score: int = 7
    bottom_window: int = 150
    rebound_window: int = 10
    ma_window: int = 20
    ma_slope_lag: int = 5
    min_drawdown_from_window_high: float = 0.25
    max_position_in_bottom_range: float = 0.45
    min_rebound_from_recent_low: float = 0.05
    max_rebound_from_recent_low: float = 0.35
    min_ret_3d: float = 0.03
    min_ret_10d: float = 0.05
    ma_reclaim_tolerance: float = 0.01
    min_ma_slope: float = -0.01
    min_vol_ratio_3d: float = 1.15
    max_vol_ratio_1d: float = 6.0
    max_abs_ret_1d: float = 0.115
    min_amount: float = 0.0
    require_drawdown: bool = True
    require_rebound: bool = True
    require_not_overextended: bool = True


def bottom_rebound(c: BottomRebound, p: Panel) -> Spec:
    n, close = c.bottom_window, F.col("close")
    top, bottom = p.high("high", n, 1), p.low("low", n, 1)
    position = F.when(top > bottom, (close - bottom) / (top - bottom))
    drawdown = F.lit(1.0) - ratio(close, top)
    rebound = change(close, p.low("low", c.rebound_window, 1))
    ma = p.mean("close", c.ma_window)
    reclaim = close >= ma * (1.0 - c.ma_reclaim_tolerance)
    vol_1d = ratio(F.col("vol"), p.mean("vol", n, 1))
    vol_3d = ratio(p.mean("vol", 3), p.mean("vol", n, 1))
    r3, r10 = p.ret(3) >= c.min_ret_3d, p.ret(c.rebound_window) >= c.min_ret_10d
    rules = [
        Rule("drawdown_ok", drawdown >= c.min_drawdown_from_window_high, 2, c.require_drawdown),
        Rule("low_position_ok", position <= c.max_position_in_bottom_range, 1, c.require_drawdown),
        Rule("rebound_ok", rebound >= c.min_rebound_from_recent_low, 2, c.require_rebound),
        Rule("not_overextended", rebound <= c.max_rebound_from_recent_low, 1, c.require_not_overextended),
        Rule("ret_3d_ok", r3),
        Rule("ret_10d_ok", r10),
        Rule("ma_reclaim", reclaim),
        Rule("ma_slope_ok", p.slope("close", c.ma_window, c.ma_slope_lag) >= c.min_ma_slope),
        Rule("vol_3d_ok", _zero(vol_3d) >= c.min_vol_ratio_3d),
        Rule("vol_calm", _zero(vol_1d) <= c.max_vol_ratio_1d, 1, c.require_not_overextended, False),
        Rule("ret_calm", F.abs(p.ret(1)) <= c.max_abs_ret_1d, 1, c.require_not_overextended, False),
        Rule("amount_ok", F.col("amount") >= c.min_amount),
    ]
    return Spec(
        rules,
        max(c.min_history, n + 1, c.rebound_window + 1, c.ma_window + c.ma_slope_lag + 1),
        n,
        None,
        _spread(top, bottom),
        vol_1d,
        vol_3d,
        reclaim,
        (holds(r3) | holds(r10)) if c.require_rebound else None,
        [number_flag("drawdown", drawdown), number_flag("rebound", rebound), number_flag("position", position)],
    )


@dataclass
class RangeSupportRebound(MinerConfig):
    min_history: int = 180
    min_candidate_score: int = 8
    total_window: int = 150
    range_window: int = 90
    recent_touch_window: int = 15
    max_range_pct: float = 0.30
    max_abs_ret_60d: float = 0.15
    support_tolerance: float = 0.04
    min_support_touches: int = 2
    max_position_in_range: float = 0.55
    breakdown_tolerance: float = 0.03
    min_rebound_from_recent_low: float = 0.03
    max_rebound_from_recent_low: float = 0.18
    min_ret_3d: float = 0.015
    min_ret_10d: float = 0.03
    max_abs_ret_1d: float = 0.08
    min_vol_ratio_3d: float = 1.05
    max_vol_ratio_1d: float = 4.0


def range_support_rebound(c: RangeSupportRebound, p: Panel) -> Spec:
    n, close = c.range_window, F.col("close")
    top, bottom = p.high("high", n, 1), p.low("low", n, 1)
    width = F.when(top > bottom, top - bottom)
    span, position = ratio(width, bottom), ratio(close - bottom, width)
    total = _spread(p.high("high", c.total_window, 1), p.low("low", c.total_window, 1))
    zone = bottom * (1.0 + c.support_tolerance)
    p.put(2, "_touch", holds(F.col("low") <= zone).cast("double"))
    touches = p.put(3, "_touches", BARS.roll(F.sum, "_touch", n, lag=1))
    recent_low = p.low("low", c.recent_touch_window, 1)
    rebound = change(close, recent_low)
    vol_1d = ratio(F.col("vol"), p.mean("vol", n, 1))
    vol_3d = ratio(p.mean("vol", 3), p.mean("vol", n, 1))
    r3, r10 = p.ret(3) >= c.min_ret_3d, p.ret(10) >= c.min_ret_10d
    rules = [
        Rule("range_sideways", span <= c.max_range_pct, 2, True),
        Rule("trend_not_strong", F.abs(p.ret(60)) <= c.max_abs_ret_60d),
        Rule("support_touches_ok", touches >= c.min_support_touches, 2, True),
        Rule("recent_support_touch", recent_low <= zone, 2, True),
        Rule("support_not_broken", close >= bottom * (1.0 - c.breakdown_tolerance), 1, True),
        Rule("near_lower_range", position <= c.max_position_in_range, 1, True),
        Rule("rebound_ok", rebound >= c.min_rebound_from_recent_low, 2, True),
        Rule("not_overextended", rebound <= c.max_rebound_from_recent_low, 1, True),
        Rule("ret_3d_ok", r3),
        Rule("ret_10d_ok", r10),
        Rule("ret_calm", F.abs(p.ret(1)) <= c.max_abs_ret_1d, 1, True, False),
        Rule("vol_3d_ok", _zero(vol_3d) >= c.min_vol_ratio_3d),
        Rule("vol_calm", _zero(vol_1d) <= c.max_vol_ratio_1d, 1, True, False),
    ]
    numbers = [
        F.when(touches.isNotNull(), F.format_string("support_touches=%.0f", touches)),
        number_flag("position", position),
        number_flag("rebound", rebound),
        number_flag("range_pct", span),
        number_flag("total_range_pct", total),
    ]
    need = max(c.min_history, c.total_window + 1, n + 1, c.recent_touch_window + 1)
    return Spec(rules, need, n, None, span, vol_1d, vol_3d, None, holds(r3) | holds(r10), numbers)


@dataclass
class SteadyUptrend(MinerConfig):
    min_history: int = 180
    min_candidate_score: int = 5
    lookback_window: int = 150
    min_ret_20d: float = 0.05
    min_ret_60d: float = 0.12
    min_position_in_range: float = 0.60
    max_drawdown_from_window_high: float = 0.18
    ma_short_window: int = 20
    ma_long_window: int = 60
    min_ma_short_slope: float = 0.0
    min_ma_long_slope: float = 0.0
    ma_slope_lag: int = 5


@dataclass
class SteadyDowntrend(MinerConfig):
    min_history: int = 180
    min_candidate_score: int = 5
    lookback_window: int = 150
    max_ret_20d: float = -0.05
    max_ret_60d: float = -0.12
    max_position_in_range: float = 0.45
    min_drawdown_from_window_high: float = 0.20
    ma_short_window: int = 20
    ma_long_window: int = 60
    max_ma_short_slope: float = 0.0
    max_ma_long_slope: float = 0.0
    ma_slope_lag: int = 5


def _steady(c, p: Panel, make_rules: Callable) -> Spec:
    n, close = c.lookback_window, F.col("close")
    top, bottom = p.high("high", n), p.low("low", n)
    position = F.when(top > bottom, (close - bottom) / (top - bottom))
    drawdown = F.lit(1.0) - ratio(close, top)
    short = p.slope("close", c.ma_short_window, c.ma_slope_lag)
    long = p.slope("close", c.ma_long_window, c.ma_slope_lag)
    return Spec(
        make_rules(position, drawdown, short, long),
        max(c.min_history, n, c.ma_long_window + c.ma_slope_lag + 1),
        n,
        base_range=_spread(top, bottom),
        vol_1d=ratio(F.col("vol"), p.mean("vol", n)),
        vol_3d=ratio(p.mean("vol", 3), p.mean("vol", n)),
        numbers=[number_flag("position", position), number_flag("drawdown", drawdown)],
    )


def steady_uptrend(c: SteadyUptrend, p: Panel) -> Spec:
    return _steady(
        c,
        p,
        lambda position, drawdown, short, long: [
            Rule("up_20d", p.ret(20) >= c.min_ret_20d),
            Rule("up_60d", p.ret(60) >= c.min_ret_60d, 2),
            Rule("high_position", position >= c.min_position_in_range),
            Rule("shallow_drawdown", drawdown <= c.max_drawdown_from_window_high),
            Rule("ma20_up", short >= c.min_ma_short_slope),
            Rule("ma60_up", long >= c.min_ma_long_slope),
        ],
    )


def steady_downtrend(c: SteadyDowntrend, p: Panel) -> Spec:
    return _steady(
        c,
        p,
        lambda position, drawdown, short, long: [
            Rule("down_20d", p.ret(20) <= c.max_ret_20d),
            Rule("down_60d", p.ret(60) <= c.max_ret_60d, 2),
            Rule("low_position", position <= c.max_position_in_range),
            Rule("meaningful_drawdown", drawdown >= c.min_drawdown_from_window_high),
            Rule("ma20_down", short <= c.max_ma_short_slope),
            Rule("ma60_down", long <= c.max_ma_long_slope),
        ],
    )


THRESHOLD_MINERS: dict[str, tuple[type, Callable]] = {
    "type_n": (TypeN, type_n),
    "downtrend_simple": (DowntrendSimple, downtrend_simple),
    "weak_sideways": (WeakSideways, weak_sideways),
    "high_volatility_range": (HighVolatilityRange, high_volatility_range),
    "fake_breakout": (FakeBreakout, fake_breakout),
    "downtrend_rebound": (DowntrendRebound, downtrend_rebound),
    "late_stage_acceleration": (LateStageAcceleration, late_stage_acceleration),
    "volume_only_spike": (VolumeOnlySpike, volume_only_spike),
    "bottom_rebound": (BottomRebound, bottom_rebound),
    "range_support_rebound": (RangeSupportRebound, range_support_rebound),
    "steady_uptrend": (SteadyUptrend, steady_uptrend),
    "steady_downtrend": (SteadyDowntrend, steady_downtrend),
}


def _score(spec: Spec) -> Column:
    return reduce(lambda a, b: a + b, [holds(r.cond).cast("int") * r.weight for r in spec.rules if r.weight])


def _accept(cfg: MinerConfig, spec: Spec, score: Column, bars: Column) -> Column:
    parts = [bars >= spec.min_rows, score >= cfg.min_candidate_score, *[holds(r.cond) for r in spec.rules if r.required]]
    accept = reduce(lambda a, b: a & b, parts)
    return accept if spec.extra is None else accept & spec.extra


def _details(name: str, spec: Spec) -> Column:
    """Descriptive columns of a candidate."""
    shown = [F.when(holds(r.cond), F.lit(r.name)) for r in spec.rules if r.shown]
    number = lambda c: F.lit(None).cast("double") if c is None else c
    return F.struct(
        F.lit(spec.label).cast("int").alias("label"),
        F.lit(name if spec.label is not None else f"{name}_candidate").alias("label_source"),
        number(spec.vol_1d).alias("vol_ratio_1d"),
        number(spec.vol_3d).alias("vol_ratio_3d"),
        F.lit(spec.window).alias("base_window_days"),
        number(spec.base_range).alias("base_range_pct"),
        (F.lit(False) if spec.breakout is None else holds(spec.breakout)).alias("breakout_flag"),
        F.concat_ws(";", *shown, *spec.numbers).alias("rule_flags"),
    )


def scan_thresholds(bars: DataFrame, configs: dict[str, MinerConfig]) -> DataFrame:
    """Run any number of threshold miners over all entities in one window stage and keep each one's top rows.

    Only scores are computed for every bar.  The rank comes next, and the texts and ratios of a candidate are built for
    the kept rows alone.
    """
    p = Panel()
    specs = {name: (cfg, THRESHOLD_MINERS[name][1](cfg, p)) for name, cfg in configs.items()}
    r1, r3, bars_n = p.ret(1), p.ret(3), p.bars()
    hits = []
    for name, (cfg, spec) in specs.items():
        score = _score(spec)
        hit = F.struct(F.lit(name).alias("miner_name"), score.alias("_score"), F.lit(cfg.top_n_per_symbol).alias("_top"))
        hits.append(F.when(_accept(cfg, spec, score, bars_n), hit))
    # the array keeps the score expressions out of the filter that drops bars without hits
    staged = p.apply(bars).select("*", F.inline(F.array_compact(F.array(*hits))))
    # same entity key as the window stage: no further exchange
    rank = F.row_number().over(W.partitionBy("ts_code", "miner_name").orderBy(F.desc("_score"), F.desc("trade_date")))
    kept = staged.withColumn("_rn", rank)
    tops = [cfg.top_n_per_symbol for cfg in configs.values()]
    if min(tops) > 0:
        # a constant bound lets the rank filter run before the sort
        kept = kept.where(F.col("_rn") <= max(tops))
    kept = kept.where((F.col("_rn") <= F.col("_top")) | (F.col("_top") <= 0))
    detail = reduce(
        lambda acc, item: acc.when(F.col("miner_name") == item[0], _details(item[0], item[1][1])), specs.items(), F
    )
    sid = sample_id("ts_code", "trade_date")
    out = kept.select(
        sid.alias("sample_id"),
        "ts_code",
        F.col("trade_date").alias("asof_date"),
        F.lit(1.0).alias("confidence"),
        F.concat_ws("_", sid, F.col("miner_name")).alias("event_id"),
        "miner_name",
        F.col("_score").alias("candidate_score"),
        "close",
        r1.alias("ret_1d"),
        r3.alias("ret_3d"),
        F.inline(F.array(detail)),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDIDATE_SCHEMA])


def complete_schema(df: DataFrame, schema: T.StructType = CANDIDATE_SCHEMA) -> DataFrame:
    """Fixed column order with typed NULLs for absent columns."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def candidate_order() -> list[Column]:
    """Score, then date, both descending with missing last; code breaks ties."""
    return [F.desc_nulls_last("candidate_score"), F.desc_nulls_last("asof_date"), F.asc("ts_code")]
