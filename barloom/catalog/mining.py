"""Threshold miners and their run job."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.timeseries import roll
from barloom.operators import miners as mn
from barloom.sources.bars import load_bars

# one wide feature table for the SQL side
PANEL_SQL = f"""
px as (select *, count(*) over (partition by ts_code) as nb,
  {', '.join(f"close / lag(close, {n}) over (partition by ts_code order by trade_date) - 1 as r{n}" for n in (1, 3, 10, 20, 60))},
  {roll('max', 'close', 60, 1)} as hh60p, {roll('min', 'close', 60, 1)} as ll60p,
  {roll('max', 'close', 60)} as hh60, {roll('min', 'close', 60)} as ll60,
  {roll('avg', 'vol', 60, 1)} as vb60p, {roll('avg', 'vol', 60)} as vb60, {roll('avg', 'vol', 3)} as v3,
  {roll('avg', 'close', 20)} as ma20, {roll('avg', 'close', 60)} as ma60,
  {roll('max', 'close', 5, -1)} as ahead,
  {roll('max', 'high', 150, 1)} as h150p, {roll('min', 'low', 150, 1)} as l150p,
  {roll('max', 'high', 150)} as h150, {roll('min', 'low', 150)} as l150,
  {roll('avg', 'vol', 150, 1)} as vb150p, {roll('avg', 'vol', 150)} as vb150,
  {roll('min', 'low', 10, 1)} as l10p, {roll('min', 'low', 15, 1)} as l15p,
  {roll('max', 'high', 90, 1)} as h90p, {roll('min', 'low', 90, 1)} as l90p, {roll('avg', 'vol', 90, 1)} as vb90p,
  (high - low) / close as span from bars),
py as (select *, {roll('avg', 'span', 20)} as span20,
  ma20 / lag(ma20, 5) over (partition by ts_code order by trade_date) - 1 as s20,
  ma60 / lag(ma60, 5) over (partition by ts_code order by trade_date) - 1 as s60,
  case when low <= l90p * 1.04 then 1.0 else 0.0 end as touch from px),
panel as (select *, {roll('sum', 'touch', 90, 1)} as touches from py)
"""

COLS = "sample_id ts_code asof_date label label_source confidence event_id miner_name candidate_score close ret_1d ret_3d vol_ratio_1d vol_ratio_3d base_window_days base_range_pct breakout_flag rule_flags"


def miner_sql(
    name: str, rules: list[tuple], min_rows: int, min_score: int, top: int, window: int, *, positive: bool = False,
    vol_1d: str = "null", vol_3d: str = "null", base: str = "null", brk: str = "false", also: str = "true", numbers: str = "",
) -> tuple[str, str]:
    """(ctes, select) for one miner; a rule is (name, condition, weight, required, shown)."""
    full = [(r + (1, False, True)[len(r) - 2:]) for r in rules]
    score = " + ".join(f"{w} * (case when {c} then 1 else 0 end)" for _, c, w, _, _ in full)
    need = " and ".join([f"({c})" for _, c, _, q, _ in full if q] + ["true"])
    shown = ", ".join(f"case when {c} then '{n}' end" for n, c, _, _, s in full if s)
    label = "cast(null as bigint)" if positive else "0"
    source = f"{name}_candidate" if positive else name
    sel = f"""select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, ts_code, trade_date as asof_date,
      cast({label} as bigint) as label, '{source}' as label_source, 1.0::double as confidence,
      concat(ts_code, '_', cast(trade_date as varchar), '_{name}') as event_id, '{name}' as miner_name,
      cast({score} as double) as candidate_score, close, r1 as ret_1d, r3 as ret_3d,
      cast({vol_1d} as double) as vol_ratio_1d, cast({vol_3d} as double) as vol_ratio_3d, cast({window} as bigint) as base_window_days,
      cast({base} as double) as base_range_pct, coalesce({brk}, false) as breakout_flag,
      concat_ws(';', {shown}{', ' + numbers if numbers else ''}) as rule_flags
      from panel where nb >= {min_rows} and ({score}) >= {min_score} and {need} and ({also})"""
    rank = f"""select {', '.join(COLS.split())} from (select *, row_number() over (partition by ts_code
      order by candidate_score desc, asof_date desc) as rn from ({sel})) where rn <= {top}"""
    return PANEL_SQL, rank


NUMS = "confidence candidate_score close ret_1d ret_3d vol_ratio_1d vol_ratio_3d base_range_pct"
_B60P, _B60 = "(hh60p - ll60p) / ll60p", "(hh60 - ll60) / ll60"
_V1P, _V3P = "vol / nullif(vb60p, 0)", "v3 / nullif(vb60p, 0)"
_BRK = "close >= hh60p * 0.99"
_POS, _DD = "(close - l150) / nullif(h150 - l150, 0)", "1 - close / h150"
_POSP, _DDP, _REB = "(close - l150p) / nullif(h150p - l150p, 0)", "1 - close / h150p", "close / l10p - 1"
_W90, _P90, _R90 = "(h90p - l90p) / l90p", "(close - l90p) / nullif(h90p - l90p, 0)", "close / l15p - 1"


def _f(fmt: str, e: str) -> str:
    return f"case when ({e}) is not null then printf('{fmt}', {e}) end"


SPECS = {
    "type_n": (
        [("base_ok", f"{_B60P} <= 0.25", 2, True, True), ("ret_1d_ok", "r1 >= 0.02"), ("ret_3d_ok", "r3 >= 0.05"),
         ("vol_1d_ok", f"{_V1P} >= 1.5"), ("vol_3d_ok", f"{_V3P} >= 1.3"), ("breakout_ok", _BRK)],
        80, 4, 10, 60, dict(positive=True, vol_1d=_V1P, vol_3d=_V3P, base=_B60P, brk=_BRK)),
    "downtrend_simple": (
        [("down_20d", "r20 <= -0.08"), ("down_60d", "r60 <= -0.15", 2, False, True), ("weak_rebound", "r3 <= 0.02"),
         ("below_ma", "(ma20 - close) / ma20 >= 0.03")], 80, 4, 5, 60, {}),
    "weak_sideways": (
        [("tight_range", f"{_B60} <= 0.12", 2, False, True), ("flat_3d", "abs(r3) <= 0.02"), ("flat_20d", "abs(r20) <= 0.04"),
         ("quiet_vol", "coalesce(v3 / nullif(vb60, 0), 0) <= 1.05")], 80, 4, 5, 60, dict(vol_3d="v3 / nullif(vb60, 0)", base=_B60)),
    "high_volatility_range": (
        [("wide_range", f"{_B60} >= 0.35", 2, False, True), ("noisy_range", "span20 >= 0.04", 2, False, True),
         ("non_trend", "abs(r20) <= 0.10")], 80, 4, 5, 60, dict(base=_B60)),
    "fake_breakout": (
        [("base_ok", f"{_B60P} <= 0.25"), ("ret_1d_ok", "r1 >= 0.02"), ("ret_3d_ok", "r3 >= 0.05"),
         ("vol_ok", f"coalesce({_V1P}, 0) >= 1.5"), ("breakout_ok", _BRK),
         ("fail_follow_through", "coalesce((ahead - close) / close, 0) <= 0.02", 1, True, True)],
        90, 5, 5, 60, dict(vol_1d=_V1P, base=_B60P, brk=_BRK)),
    "downtrend_rebound": (
        [("trend_down", "r60 <= -0.12", 2, True, True), ("rebound_up", "r3 >= 0.04", 1, True, True),
         ("still_weak", "r20 <= -0.03"), ("below_ma", "(ma20 - close) / ma20 >= 0.02")], 80, 4, 5, 60, {}),
    "late_stage_acceleration": (
        [("long_up", "r60 >= 0.30", 2, True, True), ("medium_up", "r20 >= 0.10"), ("short_accel", "r3 >= 0.05", 1, True, True),
         ("breakout_ok", "close >= hh60 * 0.98"), ("already_extended", f"{_B60} >= 0.45")],
        80, 4, 5, 60, dict(base=_B60, brk="close >= hh60 * 0.98")),
    "volume_only_spike": (
        [("spike_1d", f"coalesce({_V1P}, 0) >= 2.5", 1, True, True), ("spike_3d", f"coalesce({_V3P}, 0) >= 1.8"),
         ("weak_price_1d", "abs(r1) <= 0.02"), ("weak_price_3d", "r3 <= 0.03"),
         ("no_breakout", f"not coalesce({_BRK}, false)", 1, True, True)],
        80, 4, 5, 60, dict(vol_1d=_V1P, vol_3d=_V3P, brk=_BRK)),
    "bottom_rebound": (
        [("drawdown_ok", f"{_DDP} >= 0.25", 2, True, True), ("low_position_ok", f"{_POSP} <= 0.45", 1, True, True),
         ("rebound_ok", f"{_REB} >= 0.05", 2, True, True), ("not_overextended", f"{_REB} <= 0.35", 1, True, True),
         ("ret_3d_ok", "r3 >= 0.03"), ("ret_10d_ok", "r10 >= 0.05"), ("ma_reclaim", "close >= ma20 * 0.99"),
         ("ma_slope_ok", "s20 >= -0.01"), ("vol_3d_ok", "coalesce(v3 / nullif(vb150p, 0), 0) >= 1.15"),
         ("a", "coalesce(vol / nullif(vb150p, 0), 0) <= 6", 1, True, False), ("b", "abs(r1) <= 0.115", 1, True, False),
         ("amount_ok", "amount >= 0")],
        180, 7, 5, 150,
        dict(positive=True, vol_1d="vol / nullif(vb150p, 0)", vol_3d="v3 / nullif(vb150p, 0)", base="(h150p - l150p) / l150p",
             brk="close >= ma20 * 0.99", also="r3 >= 0.03 or r10 >= 0.05",
             numbers=", ".join([_f("drawdown=%.3f", _DDP), _f("rebound=%.3f", _REB), _f("position=%.3f", _POSP)]))),
    "range_support_rebound": (
        [("range_sideways", f"{_W90} <= 0.30", 2, True, True), ("trend_not_strong", "abs(r60) <= 0.15"),
         ("support_touches_ok", "touches >= 2", 2, True, True), ("recent_support_touch", "l15p <= l90p * 1.04", 2, True, True),
         ("support_not_broken", "close >= l90p * 0.97", 1, True, True), ("near_lower_range", f"{_P90} <= 0.55", 1, True, True),
         ("rebound_ok", f"{_R90} >= 0.03", 2, True, True), ("not_overextended", f"{_R90} <= 0.18", 1, True, True),
         ("ret_3d_ok", "r3 >= 0.015"), ("ret_10d_ok", "r10 >= 0.03"), ("a", "abs(r1) <= 0.08", 1, True, False),
         ("vol_3d_ok", "coalesce(v3 / nullif(vb90p, 0), 0) >= 1.05"),
         ("b", "coalesce(vol / nullif(vb90p, 0), 0) <= 4", 1, True, False)],
        180, 8, 5, 90,
        dict(positive=True, vol_1d="vol / nullif(vb90p, 0)", vol_3d="v3 / nullif(vb90p, 0)", base=_W90,
             also="r3 >= 0.015 or r10 >= 0.03",
             numbers=", ".join([_f("support_touches=%.0f", "touches"), _f("position=%.3f", _P90), _f("rebound=%.3f", _R90),
                                _f("range_pct=%.3f", _W90), _f("total_range_pct=%.3f", "(h150p - l150p) / l150p")]))),
    "steady_uptrend": (
        [("up_20d", "r20 >= 0.05"), ("up_60d", "r60 >= 0.12", 2, False, True), ("high_position", f"{_POS} >= 0.60"),
         ("shallow_drawdown", f"{_DD} <= 0.18"), ("ma20_up", "s20 >= 0"), ("ma60_up", "s60 >= 0")],
        180, 5, 5, 150,
        dict(vol_1d="vol / nullif(vb150, 0)", vol_3d="v3 / nullif(vb150, 0)", base="(h150 - l150) / l150",
             numbers=", ".join([_f("position=%.3f", _POS), _f("drawdown=%.3f", _DD)]))),
    "steady_downtrend": (
        [("down_20d", "r20 <= -0.05"), ("down_60d", "r60 <= -0.12", 2, False, True), ("low_position", f"{_POS} <= 0.45"),
         ("meaningful_drawdown", f"{_DD} >= 0.20"), ("ma20_down", "s20 <= 0"), ("ma60_down", "s60 <= 0")],
        180, 5, 5, 150,
        dict(vol_1d="vol / nullif(vb150, 0)", vol_3d="v3 / nullif(vb150, 0)", base="(h150 - l150) / l150",
             numbers=", ".join([_f("position=%.3f", _POS), _f("drawdown=%.3f", _DD)]))),
}


def spec_sql(name: str) -> tuple[str, str]:
    rules, rows, score, top, window, kw = SPECS[name]
    return miner_sql(name, rules, rows, score, top, window, **kw)


def _register(name: str) -> None:
    ctes, sel = spec_sql(name)

    @query(f"mine_{name}", oracle(sel, ctes, dates="asof_date", nums=NUMS))
    def _run(spark, sf):
        return mn.scan_thresholds(load_bars(spark, sf), {name: mn.THRESHOLD_MINERS[name][0]()})


for _name in SPECS:
    _register(_name)


_ALL = " union all ".join(f"({spec_sql(n)[1]})" for n in SPECS)


@query("mine_all_thresholds", oracle(_ALL, PANEL_SQL, dates="asof_date", nums=NUMS))
def _mine_all(spark, sf):
    return mn.scan_thresholds(load_bars(spark, sf), {n: mn.THRESHOLD_MINERS[n][0]() for n in SPECS})


@query(
    "mine_type_n_runup",
    oracle(
        miner_sql(
            "type_n",
            SPECS["type_n"][0] + [("runup_ok", f"close / ({roll('min', 'close', 150)}) - 1 <= 0.6", 1, True, True)],
            80, 4, 10, 60, **SPECS["type_n"][5])[1].replace("from panel where", "from panel2 where").replace(
                f"close / ({roll('min', 'close', 150)}) - 1", "runup"),
        PANEL_SQL + f", panel2 as (select *, close / ({roll('min', 'close', 150)}) - 1 as runup from panel)",
        dates="asof_date", nums=NUMS,
    ),
)
def _mine_runup(spark, sf):
    cfg = mn.TypeN(enable_runup_rule=True, runup_score_weight=1)
    return mn.scan_thresholds(load_bars(spark, sf), {"type_n": cfg})
