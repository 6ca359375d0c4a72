"""Review metrics and adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.timeseries import roll
from barloom.catalog.views import PREDS_SQL, frac, pred
from barloom.functions.cols import clamp, positive_change, safe_ratio, sample_id, sigmoid_boost, sigmoid_decay, sigmoid_rise, toward_neutral, scale_factor, weighted_mean
from barloom.functions.rolling import per_entity
from barloom.functions.windows import BARS
from barloom.operators import review as rv
from barloom.operators.history import locate
from barloom.operators.predictions import by_score
from barloom.plans.review_build import build_review_candidates
from barloom.sources.bars import load_bars

# irrational scale: products do not end in a rounding tie
IRR = 0.7071067811865476


def bars_with_means(spark, sf):
    """Bars with stored means; the 60-bar mean is missing on some days."""
    b = load_bars(spark, sf)
    return b.withColumns({
        "ma_bfq_20": BARS.mean("close", 20),
        "ma_bfq_60": F.when(F.dayofmonth("trade_date") % 9 != 0, BARS.mean("close", 60) * 1.001),
    })


MEANS_SQL = f"""mbars as (select *, {roll('avg', 'close', 20)} as ma_bfq_20,
  case when day(trade_date) % 9 <> 0 then ({roll('avg', 'close', 60)}) * 1.001::double end as ma_bfq_60 from bars)"""


def candidates(spark, sf):
    """Every bar as a candidate: anchored six bars earlier, or ten days earlier for falling bars."""
    b = load_bars(spark, sf).withColumn("prev6", BARS.lag("trade_date", 6))
    anchor = F.when(F.col("close") > F.col("open"), F.col("prev6")).otherwise(F.date_sub("trade_date", 10))
    c = b.select(
        sample_id("ts_code", "trade_date").alias("sample_id"), "ts_code", F.col("trade_date").alias("asof_date"), anchor.alias("best_phase1_date"),
        (frac("close", 7.13) * F.lit(IRR)).alias("baseline_score"),
    )
    # one code in ten has no bars
    return c.withColumn("ts_code", F.when(F.col("ts_code").endswith("7"), F.concat(F.lit("X"), "ts_code")).otherwise(F.col("ts_code")))


CAND_SQL = f"""cand as (select sample_id, case when ts_code like '%7' then concat('X', ts_code) else ts_code end as ts_code, asof_date, best_phase1_date, baseline_score from (
  select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, ts_code, trade_date as asof_date,
    case when close > open then prev6 else cast(trade_date - 10 as date) end as best_phase1_date, round(close * 7.13::double - floor(close * 7.13::double), 6) * {IRR}::double as baseline_score
  from (select *, lag(trade_date, 6) over w as prev6 from bars window w as (partition by ts_code order by trade_date))))"""


def sig(v: str, t: float, k: float, missing: str, sign: int = 1) -> str:
    """Logistic factor: sign 1 decays, -1 rises."""
    return f"(case when ({v}) is null then {missing} else 1.0 / (1.0 + exp(greatest(-60.0, least(60.0, {sign} * {k} * (({v}) - ({t})))))) end)"


METRIC_SQL = MEANS_SQL + f""", q0 as (select *, close / ({roll('min', 'close', 150)}) - 1 as runup_150,
  nullif({roll('avg', 'vol', 20, 1)}, 0) as vb, nullif({roll('avg', 'amount', 20, 1)}, 0) as ab, {roll('avg', 'vol', 3)} as v3, {roll('avg', 'vol', 2)} as v2, {roll('avg', 'amount', 2)} as a2,
  {roll('max', 'high', 30, 1, 1)} as rh, {roll('max', 'high', 60, 1)} as box_high,
  lag(close) over (partition by ts_code order by trade_date) as c1, lag(close, 2) over (partition by ts_code order by trade_date) as c2,
  power((ma_bfq_20 - ma_bfq_60) / ma_bfq_60, 2) as gap2,
  lag(ma_bfq_60, 1) over (partition by ts_code order by trade_date) as t1, lag(ma_bfq_60, 61) over (partition by ts_code order by trade_date) as t2,
  lag(ma_bfq_60, 121) over (partition by ts_code order by trade_date) as t3 from mbars),
q1 as (select *, coalesce(vol / vb >= 1.8, false) as spike, case when count(gap2) over g >= 30 then sqrt(avg(gap2) over g) end as base_ma_gap_l2 from q0
  window g as (partition by ts_code order by trade_date rows between 30 preceding and 1 preceding)),
q2 as (select *, sum(case when spike then 0 else 1 end) over (partition by ts_code order by trade_date rows unbounded preceding) as run from q1),
met as (select *, v3 / vb as volume_ratio_3d_20, case when spike then sum(case when spike then 1 else 0 end) over (partition by ts_code, run order by trade_date rows unbounded preceding) else 0 end as volume_spike_streak,
  close / c1 - 1 as burst_ret_1d, close / c2 - 1 as burst_ret_2d, vol / vb as burst_volume_ratio_1d, v2 / vb as burst_volume_ratio_2d, amount / ab as burst_amount_ratio_1d, a2 / ab as burst_amount_ratio_2d,
  rh as burst_recent_high, close / rh - 1 as burst_breakout_pct, (close - low) / nullif(high - low, 0) as burst_close_position, close / box_high - 1 as box_breakout_pct,
  t1 / t2 - 1 as base_ma60_recent_slope_pct, t2 / t3 - 1 as base_ma60_prior_slope_pct, 0.7 * abs(t1 / t2 - 1) + 0.3 * abs(t2 / t3 - 1) as base_ma60_trend_abs from q2)"""


@query(
    "volume_streak",
    oracle("select ts_code, trade_date, volume_ratio_3d_20 as volume_ratio, volume_spike_streak from met", METRIC_SQL, dates="trade_date", nums="volume_ratio", ints="volume_spike_streak"),
)
def _streak(spark, sf):
    return rv.with_volume_metrics(load_bars(spark, sf)).select("ts_code", "trade_date", "volume_ratio", "volume_spike_streak")


@query(
    "burst_metrics",
    oracle(f"select ts_code, trade_date, {', '.join(rv.BURST_COLUMNS)} from met", METRIC_SQL, dates="trade_date", nums=" ".join(rv.BURST_COLUMNS)),
)
def _burst(spark, sf):
    return load_bars(spark, sf).withColumns(rv.burst_metrics()).select("ts_code", "trade_date", *rv.BURST_COLUMNS)


@query(
    "base_stability_metrics",
    oracle("select ts_code, trade_date, base_ma_gap_l2, base_ma60_recent_slope_pct, base_ma60_prior_slope_pct, base_ma60_trend_abs from met",
           METRIC_SQL.replace("count(gap2) over g >= 30", "count(gap2) over g >= 8").replace("rows between 30 preceding", "rows between 8 preceding"),
           dates="trade_date", nums="base_ma_gap_l2 base_ma60_recent_slope_pct base_ma60_prior_slope_pct base_ma60_trend_abs"),
)
def _stability(spark, sf):
    b = rv.with_base_stability(bars_with_means(spark, sf), 60)
    short = rv.with_base_stability(bars_with_means(spark, sf), 8)
    keep = b.select("ts_code", "trade_date", "base_ma60_recent_slope_pct", "base_ma60_prior_slope_pct", "base_ma60_trend_abs")
    return keep.join(short.select("ts_code", "trade_date", "base_ma_gap_l2"), ["ts_code", "trade_date"])


@query("box_breakout_metrics", oracle("select ts_code, trade_date, box_high, box_breakout_pct from met", METRIC_SQL, dates="trade_date", nums="box_high box_breakout_pct"))
def _box(spark, sf):
    return load_bars(spark, sf).withColumns(rv.box_metrics()).select("ts_code", "trade_date", "box_high", "box_breakout_pct")


@query(
    "runup_values",
    oracle("select c.sample_id, c.ts_code, c.asof_date, m.runup_150 from cand c left join met m on m.ts_code = c.ts_code and m.trade_date = c.asof_date",
           f"{METRIC_SQL}, {CAND_SQL}", dates="asof_date", nums="runup_150"),
)
def _runup(spark, sf):
    b = load_bars(spark, sf).withColumn("runup_150", rv.runup_metric(150))
    return rv.attach_metrics(candidates(spark, sf), b, ["runup_150"]).select("sample_id", "ts_code", "asof_date", "runup_150")


TREND_SQL = MEANS_SQL + f""", tr0 as (select *, coalesce(ma_bfq_20, {roll('avg', 'close', 20)}) as ms, coalesce(ma_bfq_60, {roll('avg', 'close', 60)}) as mm, {roll('avg', 'close', 110)} as ml,
  lag(close, 120) over (partition by ts_code order by trade_date) as c120, max(high) over f as hh, min(low) over f as ll from mbars window f as (partition by ts_code order by trade_date rows 119 preceding)),
tr1 as (select *, close / mm - 1 as pm, close / ml - 1 as pl, mm / lag(mm, 20) over w - 1 as s1, ml / lag(ml, 20) over w - 1 as s2, close / c120 - 1 as ret, (close - ll) / nullif(hh - ll, 0) as pos from tr0
  window w as (partition by ts_code order by trade_date)),
tr as (select *, (case when ret >= 0 then 1 else 0 end + case when s1 >= 0 then 1 else 0 end + case when pos >= 0.45 then 1 else 0 end + case when pm >= 0 then 1 else 0 end) / 4.0 as score from tr1)"""


@query(
    "midlong_trend_metrics",
    oracle(
        """select c.sample_id, t.trade_date as trend_data_date, t.close as trend_close, ms as trend_ma_short, mm as trend_ma_mid, ml as trend_ma_long, pm as trend_price_vs_mid_ma, pl as trend_price_vs_long_ma,
           s1 as trend_mid_ma_slope, s2 as trend_long_ma_slope, ret as trend_return, pos as trend_position, score as trend_midlong_score, coalesce(score = 1, false) as trend_midlong_pass
           from (select sample_id, ts_code, cast(asof_date + 2 as date) as asof_date from cand) c asof left join tr t on t.ts_code = c.ts_code and c.asof_date >= t.trade_date""",
        f"{TREND_SQL}, {CAND_SQL}", dates="trend_data_date", nums=" ".join(c for c in rv.TREND_COLUMNS if c not in ("trend_data_date", "trend_midlong_pass")),
    ),
)
def _trend(spark, sf):
    c = candidates(spark, sf).withColumn("asof_date", F.date_add("asof_date", 2))
    return rv.attach_trend(c, bars_with_means(spark, sf), rv.Trend(long_window=110)).select("sample_id", *rv.TREND_COLUMNS)


HIST_SQL = CAND_SQL + """, hx as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars),
hw as (select c.sample_id, c.ts_code, c.asof_date, b.close, b.vol, b.rn, e.rn as ern, e.close as now from cand c join hx e on e.ts_code = c.ts_code and e.trade_date = c.asof_date
  join hx b on b.ts_code = c.ts_code and b.rn between e.rn - 149 and e.rn),
hb0 as (select *, min(close) over (partition by sample_id) as lo0, max(close) over (partition by sample_id) as hi0 from hw),
hb as (select * exclude (lo0, hi0), case when lo0 = hi0 then lo0 - greatest(abs(lo0) * 0.001, 0.01) else lo0 end as lo, case when lo0 = hi0 then hi0 + greatest(abs(lo0) * 0.001, 0.01) else hi0 end as hi from hb0),
hc as (select *, least(49, cast(floor((close - lo) / (hi - lo) * 50) as int)) as bin, least(49, cast(floor((now - lo) / (hi - lo) * 50) as int)) as nbin from hb)"""


@query(
    "price_histogram",
    oracle("select sample_id, count(distinct bin) as bins, sum(vol) as volume, sum(bin * vol) as placed_volume, any_value(nbin) as last_bin, any_value(lo) as bin_low, any_value(hi) as bin_high from hc group by sample_id", HIST_SQL,
           nums="volume placed_volume bin_low bin_high", ints="bins last_bin"),
)
def _histogram(spark, sf):
    """One row per candidate with sums over its bins, so that every bar can be a candidate."""
    at = _located(spark, sf)
    h = rv.price_histogram(at, load_bars(spark, sf), 150)
    total = lambda e: F.aggregate("bins", F.lit(0.0), lambda a, x: a + e(x))
    sums = h.select(
        "ts_code", "pos", F.size("bins").alias("bins"), total(lambda x: x["volume"]).alias("volume"), total(lambda x: x["bin"] * x["volume"]).alias("placed_volume"),
        "last_bin", "bin_low", "bin_high",
    )
    return at.join(sums, ["ts_code", "pos"]).drop("ts_code", "pos")


def _located(spark, sf):
    return locate(candidates(spark, sf).select(*rv.KEYS), load_bars(spark, sf)).select("sample_id", "ts_code", "pos")


@query(
    "overhang_ratio",
    oracle("select sample_id, greatest(0, least(1, coalesce(sum(vol) filter (where bin > nbin), 0) / sum(vol))) as overhang_ratio from hc group by sample_id", HIST_SQL, nums="overhang_ratio"),
)
def _overhang_ratio(spark, sf):
    at = _located(spark, sf)
    return at.join(rv.overhang_ratio(rv.price_histogram(at, load_bars(spark, sf), 150)), ["ts_code", "pos"]).select("sample_id", "overhang_ratio")


OVER_SQL = HIST_SQL + """, ov as (select sample_id, coalesce(sum(vol) filter (where bin > nbin), 0) / sum(vol) as r from hc group by sample_id)"""


@query(
    "overhang_values",
    oracle("select c.sample_id, r as overhang_ratio, " + f"case when r is null then 1.0 else 0.4 + 0.6 * {sig('r', 0.35, 12.0, 'null')} end as overhang_factor" + " from cand c left join ov using (sample_id)",
           OVER_SQL, nums="overhang_ratio overhang_factor"),
)
def _overhang(spark, sf):
    o = rv.attach_overhang(candidates(spark, sf), load_bars(spark, sf))
    return o.select("sample_id", "overhang_ratio", rv.overhang_factor(F.col("overhang_ratio")).alias("overhang_factor"))


P2_SQL = CAND_SQL + """, px2 as (select *, row_number() over (partition by ts_code order by trade_date) as rn, lag(close) over (partition by ts_code order by trade_date) as prev from bars),
pa as (select c.*, (select max(rn) from px2 x where x.ts_code = c.ts_code and x.trade_date <= c.asof_date) as z, (select max(rn) from px2 x where x.ts_code = c.ts_code and x.trade_date <= c.best_phase1_date) as a from cand c),
pj as (select pa.sample_id, pa.a, pa.z, pa.best_phase1_date, b.*, (b.high - b.low) / b.close as rng from pa join px2 b on b.ts_code = pa.ts_code and b.rn between pa.a - 20 and pa.z where pa.a < pa.z),
pg as (select sample_id, any_value(best_phase1_date) as phase2_anchor_date, any_value(z - a) as phase2_days_since_anchor, avg(vol) filter (where rn < a) as phase2_pre_avg_volume,
  avg(vol) filter (where rn >= a and rn < a + 2) as phase2_burst_avg_volume, avg(vol) filter (where rn > a and rn > z - 5) as phase2_pullback_avg_volume, avg(vol) filter (where rn > a and rn > z - 2) as phase2_recent_avg_volume,
  avg(vol) filter (where rn > a and rn > z - 5 and close < prev) as dn, avg(vol) filter (where rn > a and rn > z - 5 and close >= prev) as up,
  max(high) filter (where rn = a) as phase2_anchor_high, max(low) filter (where rn = a) as phase2_anchor_low, max(close) filter (where rn = a) as phase2_anchor_close, max(high) filter (where rn >= a) as phase2_post_anchor_high,
  min(low) filter (where rn > a) as phase2_pullback_low, max(close) filter (where rn = z) as phase2_current_close, avg(rng) filter (where rn > a and rn > z - 5) as phase2_pullback_avg_range_pct,
  max(high) filter (where rn > a and rn > z - 2) as rh, min(low) filter (where rn > a and rn > z - 2) as rl from pj group by sample_id),
p2 as (select * exclude (dn, up, rh, rl), phase2_pullback_avg_volume / phase2_pre_avg_volume as phase2_pullback_volume_vs_pre, phase2_recent_avg_volume / phase2_pre_avg_volume as phase2_recent_volume_vs_pre,
  phase2_pullback_avg_volume / phase2_burst_avg_volume as phase2_pullback_volume_vs_burst, dn / up as phase2_down_volume_pressure, 1 - phase2_current_close / phase2_post_anchor_high as phase2_pullback_depth_pct,
  phase2_current_close / phase2_anchor_close - 1 as phase2_close_to_anchor_close_pct, phase2_pullback_low / phase2_anchor_low - 1 as phase2_low_to_anchor_low_pct, phase2_current_close / phase2_anchor_high - 1 as phase2_chase_extension_pct,
  (phase2_anchor_high - phase2_anchor_low) / phase2_anchor_close as phase2_anchor_range_pct, phase2_pullback_avg_range_pct / ((phase2_anchor_high - phase2_anchor_low) / phase2_anchor_close) as phase2_range_contraction_ratio,
  (rh - rl) / phase2_current_close as phase2_recent_range_pct from pg)"""
P2_NUMS = (
    "phase2_pre_avg_volume phase2_burst_avg_volume phase2_pullback_avg_volume phase2_recent_avg_volume phase2_anchor_high phase2_anchor_low phase2_anchor_close phase2_post_anchor_high phase2_pullback_low "
    "phase2_current_close phase2_pullback_avg_range_pct phase2_pullback_volume_vs_pre phase2_recent_volume_vs_pre phase2_pullback_volume_vs_burst phase2_down_volume_pressure phase2_pullback_depth_pct "
    "phase2_close_to_anchor_close_pct phase2_low_to_anchor_low_pct phase2_chase_extension_pct phase2_anchor_range_pct phase2_range_contraction_ratio phase2_recent_range_pct"
)


@query("phase2_pullback_metrics", oracle("select * from p2", P2_SQL, dates="phase2_anchor_date", nums=P2_NUMS, ints="phase2_days_since_anchor"))
def _phase2(spark, sf):
    return rv.pullback_metrics(candidates(spark, sf), load_bars(spark, sf)).drop("ts_code", "asof_date")


def chip_bars(spark, sf):
    """Bars with cost percentiles of the trailing closes; missing on every fifth day."""
    b = load_bars(spark, sf).withColumn("close", F.col("close") * F.lit(IRR))
    ps = {"cost_5pct": 0.05, "cost_15pct": 0.15, "cost_50pct": 0.5, "cost_85pct": 0.85, "cost_95pct": 0.95}
    shares, names = list(ps.values()), [*ps, "weight_avg", "winner_rate"]

    def costs(s):
        close = s["close"]
        found = [*close.quantiles(30, shares), close.mean(30, min_periods=1), s["__up"].mean(30, min_periods=1)]
        return dict(zip(names, found))

    up = F.when(F.col("close") > F.col("open") * F.lit(IRR), 1.0).otherwise(0.0)
    b = per_entity(b.select("ts_code", "trade_date", "close", up.alias("__up")), ["close", "__up"], names, costs)
    hole = F.dayofmonth("trade_date") % 5 == 0
    return b.select("ts_code", "trade_date", "close", *[F.when(~hole, F.col(n)).alias(n) for n in names])


CHIP_SQL = CAND_SQL + f""", sbars as (select * replace (close * {IRR}::double as close, open * {IRR}::double as open) from bars)""" + """, chip as (select ts_code, trade_date, close, row_number() over (partition by ts_code order by trade_date) as rn, """ + ", ".join(
    f"case when day(trade_date) % 5 <> 0 then quantile_cont(close, {p}) over f end as {n}" for n, p in (("cost_5pct", 0.05), ("cost_15pct", 0.15), ("cost_50pct", 0.5), ("cost_85pct", 0.85), ("cost_95pct", 0.95))
) + """, case when day(trade_date) % 5 <> 0 then avg(close) over f end as weight_avg, case when day(trade_date) % 5 <> 0 then avg(case when close > open then 1.0 else 0.0 end) over f end as winner_rate
  from sbars window f as (partition by ts_code order by trade_date rows 29 preceding)),
cz as (select c.*, (select max(rn) from chip x where x.ts_code = c.ts_code and x.trade_date <= c.asof_date) as z, (select max(rn) from chip x where x.ts_code = c.ts_code and x.trade_date < c.best_phase1_date) as a,
  coalesce((select max(rn) from chip x where x.ts_code = c.ts_code and x.trade_date <= c.asof_date and x.weight_avg is not null),
    (select max(rn) from chip x where x.ts_code = c.ts_code and x.trade_date <= c.asof_date)) as k from cand c),
cm as (select cz.sample_id, avg(weight_avg) filter (where rn <= a and rn > a - 60) as pw, avg(weight_avg) filter (where case when best_phase1_date is null then rn > z - 60 else rn > coalesce(a, 0) end) as qw, avg(winner_rate) filter (where rn <= a and rn > a - 60) as pr,
  avg(winner_rate) filter (where case when best_phase1_date is null then rn > z - 60 else rn > coalesce(a, 0) end) as qr from cz join chip b on b.ts_code = cz.ts_code and b.rn <= cz.z group by cz.sample_id)"""
CHIP_NUMS = (
    "chip_current_close chip_cost_5pct chip_cost_15pct chip_cost_50pct chip_cost_85pct chip_cost_95pct chip_weight_avg chip_winner_rate chip_price_vs_cost_50 chip_price_vs_cost_85 chip_price_vs_cost_95 "
    "chip_price_vs_weight_avg chip_cost_band_width_15_85 chip_cost_band_width_5_95 chip_pre_weight_avg_mean chip_post_weight_avg_mean chip_center_shift chip_pre_winner_rate_mean chip_post_winner_rate_mean chip_winner_rate_change"
)


@query(
    "chip_structure",
    oracle(
        """select cz.sample_id, best_phase1_date as chip_anchor_date, k.trade_date as chip_data_date, n.close as chip_current_close, k.cost_5pct as chip_cost_5pct, k.cost_15pct as chip_cost_15pct, k.cost_50pct as chip_cost_50pct,
           k.cost_85pct as chip_cost_85pct, k.cost_95pct as chip_cost_95pct, k.weight_avg as chip_weight_avg, k.winner_rate as chip_winner_rate, n.close / k.cost_50pct - 1 as chip_price_vs_cost_50, n.close / k.cost_85pct - 1 as chip_price_vs_cost_85,
           n.close / k.cost_95pct - 1 as chip_price_vs_cost_95, n.close / k.weight_avg - 1 as chip_price_vs_weight_avg, k.cost_85pct / k.cost_15pct - 1 as chip_cost_band_width_15_85, k.cost_95pct / k.cost_5pct - 1 as chip_cost_band_width_5_95,
           pw as chip_pre_weight_avg_mean, qw as chip_post_weight_avg_mean, qw / pw - 1 as chip_center_shift, pr as chip_pre_winner_rate_mean, qr as chip_post_winner_rate_mean, qr - pr as chip_winner_rate_change,
           coalesce(k.cost_50pct between n.close * 0.97 and n.close * 1.03, false) as chip_near_price_has_cost_50, coalesce(k.weight_avg between n.close * 0.97 and n.close * 1.03, false) as chip_near_price_has_weight_avg
           from cz left join chip n on n.ts_code = cz.ts_code and n.rn = cz.z left join chip k on k.ts_code = cz.ts_code and k.rn = cz.k left join cm on cm.sample_id = cz.sample_id""",
        CHIP_SQL, dates="chip_anchor_date chip_data_date", nums=CHIP_NUMS,
    ),
)
def _chip(spark, sf):
    c = rv.chip_structure(candidates(spark, sf), chip_bars(spark, sf), anchor_date_col="best_phase1_date")
    return c.drop("ts_code", "asof_date")


NH = rv.NewHigh(rolling_window=300, min_periods=100, min_high_ratio=0.85, max_high_ratio=1.05, min_avg_amount=50_000.0)
NH_SQL = """nh0 as (select *, row_number() over (partition by ts_code order by trade_date) as rn, max(high) over (partition by ts_code order by trade_date rows between 300 preceding and 1 preceding) as prev,
  avg(amount) over (partition by ts_code order by trade_date rows 19 preceding) as amt from bars),
nh1 as (select *, case when rn > 100 then close / prev end as r from nh0),
nh as (select *, case when rn <= 100 then 'insufficient_history' when r < 0.85 then 'high_ratio_below_min' when r > 1.05 then 'high_ratio_above_max' when amt < 50000 then 'avg_amount_below_min' else 'pass' end as reason,
  case when r < 1.0 then 0.65 + (least(1.0, greatest(0.85, r)) - 0.85) / 0.15 * 0.30 when r < 1.02 then 1.0 + (r - 1.0) / 0.02 * 0.25 when r <= 1.08 then 1.25 when r <= 1.2 then 1.25 - (r - 1.08) / 0.12 * 0.55 when r is not null then 0.45 end as factor,
  case when r < 1.0 then 'near_high_not_breakout' when r < 1.02 then 'fresh_breakout' when r <= 1.08 then 'confirmed_breakout_ideal' when r <= 1.2 then 'extended_breakout' when r is not null then 'too_extended' end as why from nh1)"""


@query(
    "new_high_review",
    oracle(
        """select ts_code, trade_date, reason = 'pass' as new_high_review_pass, reason as new_high_review_reason, case when rn > 100 then prev end as high_3y_prev, r as high_ratio_750, 1 - r as distance_to_high_750,
           case when r between 0.85 and 1.05 then amt end as avg_amount_20d, factor as new_high_score_factor, why as new_high_score_reason from nh""",
        NH_SQL, dates="trade_date", nums="high_3y_prev high_ratio_750 distance_to_high_750 avg_amount_20d new_high_score_factor",
    ),
)
def _new_high(spark, sf):
    return rv.with_new_high(load_bars(spark, sf), NH).select("ts_code", "trade_date", *rv.NEW_HIGH_COLUMNS)


@query(
    "high_ratio_bands",
    oracle("select ts_code, trade_date, factor as factor, why as reason from nh where r is not null", NH_SQL, dates="trade_date", nums="factor"),
)
def _bands(spark, sf):
    b = rv.with_new_high(load_bars(spark, sf), NH).where("high_ratio_750 is not null")
    f, why = rv.high_ratio_factor(F.col("high_ratio_750"), NH)
    return b.select("ts_code", "trade_date", f.alias("factor"), why.alias("reason"))


@query(
    "scalar_factors",
    oracle(
        f"""select ts_code, trade_date, {sig('r', 0.02, 30.0, '1.0')} as decay, {sig('r', 0.02, 30.0, '0.0', -1)} as rise, case when r is null then 1.0 else 1.0 + 0.15 * {sig('r', 0.02, 30.0, 'null', -1)} end as boost,
            1.0 + 0.4 * ({sig('r', 0.02, 30.0, '1.0')} - 1.0) as weighted, case when r is not null then 0.3 + 0.9 * greatest(0, least(1, r * 10)) end as scaled, case when abs(r) > 1e-12 then vol / r end as safe, greatest(0, least(1, r * 20)) as clamped,
            case when lag(close, 3) over (partition by ts_code order by trade_date) > 0 then close / lag(close, 3) over (partition by ts_code order by trade_date) - 1 end as change_3,
            round(greatest(0, least(1, (greatest(0, least(1, r * 10)) * 0.6 + 0.5 * 0.2) / 0.8)), 6) as combined
            from (select *, close / lag(close) over (partition by ts_code order by trade_date) - 1 as r from bars)""",
        dates="trade_date", nums="decay rise boost weighted scaled safe clamped change_3 combined",
    ),
)
def _scalars(spark, sf):
    b = load_bars(spark, sf).withColumn("r", BARS.pct("close"))
    r = F.col("r")
    return b.select(
        "ts_code", "trade_date", sigmoid_decay(r, 0.02, 30.0).alias("decay"), sigmoid_rise(r, 0.02, 30.0).alias("rise"), sigmoid_boost(r, 0.02, 30.0, 0.15).alias("boost"),
        toward_neutral(sigmoid_decay(r, 0.02, 30.0), 0.4).alias("weighted"), scale_factor(r * 10, 0.3, 1.2).alias("scaled"), safe_ratio(F.col("vol"), r).alias("safe"),
        clamp(r * 20).alias("clamped"), positive_change(F.col("close"), BARS.lag("close", 3)).alias("change_3"),
        weighted_mean([(clamp(r * 10), 0.6), (F.lit(0.5), 0.2)]).alias("combined"),
    )


STAGES = {
    "runup": {"enabled": True},
    "volume": {"enabled": True},
    "burst_strength": {"enabled": True},
    "base_stability": {"enabled": True, "window": 60},
    "box_breakout": {"enabled": True, "weight": 0.8},
    "overhang": {"enabled": True},
    "midlong_trend": {"enabled": True, "score_col": "adjusted_score"},
    "phase2_volume_hold": {"enabled": True, "score_col": "adjusted_score"},
    "phase2_pullback_compact": {"enabled": True, "score_col": "adjusted_score"},
}
_price = f"greatest({sig('burst_ret_1d', 0.12, 25.0, '0.0', -1)}, {sig('burst_ret_2d', 0.16, 25.0, '0.0', -1)})"
_vols = f"greatest({sig('burst_volume_ratio_1d', 4.0, 1.4, '0.0', -1)}, {sig('burst_volume_ratio_2d', 3.0, 1.4, '0.0', -1)})"
_gap30 = "cast(null as double)"
ADJ_SQL = f"""{METRIC_SQL}, {TREND_SQL[len(MEANS_SQL) + 2:]}, {OVER_SQL}, {P2_SQL[len(CAND_SQL) + 2:]},
gap60 as (select ts_code, trade_date, case when count(gap2) over g >= 60 then sqrt(avg(gap2) over g) end as gl from q0 window g as (partition by ts_code order by trade_date rows between 60 preceding and 1 preceding)),
adj0 as (select c.sample_id, c.ts_code, c.asof_date, c.baseline_score, m.* exclude (ts_code, trade_date, base_ma_gap_l2), g.gl, o.r as ovr, t.s1, p.* exclude (sample_id) from cand c
  left join met m on m.ts_code = c.ts_code and m.trade_date = c.asof_date left join gap60 g on g.ts_code = c.ts_code and g.trade_date = c.asof_date
  left join ov o on o.sample_id = c.sample_id left join tr t on t.ts_code = c.ts_code and t.trade_date = c.asof_date left join p2 p on p.sample_id = c.sample_id),
adj as (select *, {sig('runup_150', 0.35, 20.0, '1.0')} as f1,
  (case when volume_ratio_3d_20 is null then 1.0 else 1.0 + 0.15 * {sig('volume_ratio_3d_20', 1.8, 3.0, 'null', -1)} end) * {sig('volume_spike_streak', 3.0, 1.5, '1.0')} as f2,
  1.0 + 0.45 * (0.30 * {_price} + 0.30 * {_vols} + 0.15 * {sig('burst_amount_ratio_1d', 3.5, 1.3, '0.0', -1)} + 0.15 * {sig('burst_breakout_pct', -0.01, 80.0, '0.0', -1)} + 0.10 * {sig('burst_close_position', 0.75, 8.0, '0.0', -1)}) as f3,
  {sig('gl', 0.04, 80.0, '1.0')} * {sig('base_ma60_trend_abs', 0.08, 25.0, '1.0')} as f4,
  1.0 + 0.8 * ((0.3 + 0.9 * ((case when box_breakout_pct is null then 0.0 else 1.0 + {sig('box_breakout_pct', -0.01, 80.0, 'null', -1)} end) - 1.0)) - 1.0) as f5,
  case when ovr is null then 1.0 else 0.4 + 0.6 * {sig('ovr', 0.35, 12.0, 'null')} end as f6,
  0.25 + 1.10 * {sig('s1', 0.0, 80.0, '0.0', -1)} as f7,
  0.35 + 1.0 * (0.55 * {sig('phase2_pullback_volume_vs_pre', 1.6, 3.0, '0.0', -1)} + 0.25 * {sig('phase2_recent_volume_vs_pre', 1.3, 3.0, '0.0', -1)} + 0.10 * {sig('phase2_pullback_volume_vs_burst', 1.05, 4.0, '0.5')} + 0.10 * {sig('phase2_down_volume_pressure', 1.5, 3.0, '0.7')}) as f8,
  0.45 + 0.80 * (0.25 * {sig('phase2_pullback_depth_pct', 0.14, 40.0, '0.0')} + 0.10 * {sig('phase2_pullback_depth_pct', 0.0, 60.0, '0.0', -1)} + 0.25 * {sig('phase2_low_to_anchor_low_pct', -0.06, 50.0, '0.0', -1)}
    + 0.20 * {sig('phase2_range_contraction_ratio', 0.95, 8.0, '0.0')} + 0.10 * {sig('phase2_recent_range_pct', 0.12, 35.0, '0.0')} + 0.10 * {sig('phase2_chase_extension_pct', 0.12, 35.0, '0.5')}) as f9 from adj0)"""
FACTORS = ["runup_penalty_factor", "volume_penalty_factor", "burst_strength_factor", "base_stability_factor", "box_breakout_factor", "overhang_factor",
           "trend_ma_factor", "phase2_volume_hold_factor", "phase2_pullback_compact_factor"]


@query(
    "adjust_all_stages",
    oracle(
        f"select sample_id, baseline_score, {', '.join(f'f{i + 1} as {n}' for i, n in enumerate(FACTORS))}, baseline_score * {' * '.join(f'f{i + 1}' for i in range(9))} as adjusted_score from adj",
        ADJ_SQL, nums=f"baseline_score adjusted_score {' '.join(FACTORS)}",
    ),
)
def _all_stages(spark, sf):
    out = rv.apply_adjustments(candidates(spark, sf), bars_with_means(spark, sf), STAGES)
    return out.select("sample_id", "baseline_score", *FACTORS, "adjusted_score")


def _single(stage: str, index: int) -> None:
    cfg = {**STAGES[stage], "score_col": "baseline_score", "output_score_col": "adjusted_score"}

    @query(
        f"adjust_{stage}",
        oracle(f"select sample_id, f{index} as {FACTORS[index - 1]}, baseline_score * f{index} as adjusted_score from adj", ADJ_SQL, nums=f"{FACTORS[index - 1]} adjusted_score"),
    )
    def _run(spark, sf):
        out = rv.apply_adjustments(candidates(spark, sf), bars_with_means(spark, sf), {stage: cfg})
        return out.select("sample_id", FACTORS[index - 1], "adjusted_score")


for _i, _stage in enumerate(STAGES):
    _single(_stage, _i + 1)


@query(
    "adjust_chip_fields",
    oracle(
        "select cz.sample_id, baseline_score, n.close / k.cost_50pct - 1 as chip_price_vs_cost_50, qw / pw - 1 as chip_center_shift from cz left join chip n on n.ts_code = cz.ts_code and n.rn = cz.z left join chip k on k.ts_code = cz.ts_code and k.rn = cz.k left join cm on cm.sample_id = cz.sample_id",
        CHIP_SQL, nums="baseline_score chip_price_vs_cost_50 chip_center_shift",
    ),
)
def _chip_fields(spark, sf):
    cfg = {"chip_structure": {"enabled": True, "anchor_date_col": "best_phase1_date"}}
    out = rv.apply_adjustments(candidates(spark, sf), chip_bars(spark, sf), cfg)
    return out.select("sample_id", "baseline_score", "chip_price_vs_cost_50", "chip_center_shift")


@query(
    "review_candidates",
    oracle(
        """select sample_id, ts_code, asof_date, row_number() over (order by pass_count desc, adj desc, baseline_score desc, baseline_rank, specialist_rank_sum) as review_rank, baseline_name, baseline_rank, baseline_score, adj as adjusted_score, pass_count
           from (select b.*, b.baseline_score * f1 as adj from b0 b join rx using (sample_id))""",
        PREDS_SQL + f""", rm as (select ts_code, trade_date, close / ({roll('min', 'close', 150)}) - 1 as ru from bars),
          s1 as (select sample_id, row_number() over (order by score desc, sample_id) as r1 from pred_b order by score desc, sample_id limit 400),
          s2 as (select sample_id, row_number() over (order by score desc, sample_id) as r2 from pred_b where ts_code like '%1' or ts_code like '%2'),
          b00 as (select sample_id, ts_code, asof_date, row_number() over (order by score desc, sample_id) as baseline_rank, score as baseline_score, 'base' as baseline_name from pred_a order by score desc, sample_id limit 500),
          b0 as (select b.*, case when r1 <= 400 then 1 else 0 end + case when r2 <= 50 then 1 else 0 end as pass_count, coalesce(r1, 1000000000) + coalesce(r2, 1000000000) as specialist_rank_sum from b00 b left join s1 using (sample_id) left join s2 using (sample_id)),
          rx as (select sample_id, {sig('ru', 0.35, 20.0, '1.0')} as f1 from b0 left join rm on rm.ts_code = b0.ts_code and rm.trade_date = b0.asof_date)""",
        dates="asof_date", nums="baseline_score adjusted_score", ints="review_rank baseline_rank pass_count",
    ),
)
def _review(spark, sf):
    a, b = pred(spark, sf, 7.13), pred(spark, sf, 3.77)
    out = build_review_candidates(
        {"name": "base", "predictions": a, "score_col": "score", "order": by_score("score"), "top_n": 500},
        [
            {"name": "wide", "predictions": b, "score_col": "score", "order": by_score("score"), "top_n": 400},
            {"name": "narrow", "predictions": b.where("ts_code like '%1' or ts_code like '%2'"), "score_col": "score", "order": by_score("score"), "pass_rank": 50},
        ],
        load_bars(spark, sf),
        {"runup": {"enabled": True}},
    )
    return out.select("sample_id", "ts_code", "asof_date", "review_rank", "baseline_name", "baseline_rank", "baseline_score", "adjusted_score", "pass_count")


