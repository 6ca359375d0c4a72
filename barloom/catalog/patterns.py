"""Pullback sampler, base miners, legacy detector, ordering and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.mining import COLS, NUMS, PANEL_SQL, spec_sql
from barloom.catalog.timeseries import roll
from barloom.catalog.views import HITS_SQL, PREDS_SQL, hits, pred
from barloom.functions.windows import BARS
from barloom.operators import bases, legacy, miners as mn, pullback as pb, selection as sel
from barloom.operators.legacy import indicators
from barloom.plans.mining import mine_many
from barloom.sources.bars import load_bars


def frame(agg: str, c: str, lo: int, hi: int) -> str:
    return f"{agg}({c}) over (partition by ts_code order by trade_date rows between {lo} following and {hi} following)"


def pull_sql(rise: float, low: float, high: float, days: int, speed: float) -> str:
    fut = ", ".join(
        f"""{frame('max', 'high', 1, n)} / close - 1 as diagnostic_future_max_return_{n}d,
            {frame('min', 'low', 1, n)} / close - 1 as diagnostic_future_min_return_{n}d,
            lead(close, {n}) over (partition by ts_code order by trade_date) / close - 1 as diagnostic_future_close_return_{n}d"""
        for n in (5, 10, 20)
    )
    return f"""
pr as (select *, row_number() over (partition by ts_code order by trade_date) as rn, count(*) over (partition by ts_code) as nb,
  close / lag(close) over (partition by ts_code order by trade_date) - 1 as ret,
  max(close) over (partition by ts_code order by trade_date rows 89 preceding) as hi from bars),
pd as (select *, close / ({roll('avg', 'close', 5)}) - 1 as ma5_distance, close / ({roll('avg', 'close', 20)}) - 1 as ma20_distance,
  close / ({roll('avg', 'close', 60)}) - 1 as ma60_distance, {roll('stddev_samp', 'ret', 20)} as volatility_20d,
  vol / nullif({roll('avg', 'vol', 20)}, 0) as volume_ratio_20, {fut} from pr),
pk as (select p.ts_code, p.trade_date, min(q.rn) as hrn from pr p join pr q on q.ts_code = p.ts_code and q.rn between p.rn - 89 and p.rn and q.close = p.hi
  where p.rn >= 90 group by p.ts_code, p.trade_date),
pm as (select p.*, k.hrn, h.trade_date as hdate, (select min(l.close) from pr l where l.ts_code = p.ts_code and l.rn between p.rn - 89 and k.hrn) as lo
  from pd p join pk k using (ts_code, trade_date) join pr h on h.ts_code = p.ts_code and h.rn = k.hrn),
pn as (select *, rn - hrn as days, hi / lo - 1 as rise, -(close / hi - 1) as depth,
  case when rn > hrn then -(close / hi - 1) / (rn - hrn) end as speed from pm),
pulls as (select *, case when rise < {rise} then 'no_prior_rise' when days < 1 or depth < {low} then 'no_pullback'
  when days > {days} then 'stale_pullback' when depth > {high} then 'too_deep_drawdown' when speed < {speed} then 'slow_pullback'
  else 'simple_pullback' end as sub from pn)"""


PULL_SELECT = """select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, ts_code, trade_date as asof_date,
  case when sub = 'simple_pullback' then 1 else 0 end as label, 'pattern' as label_type, 'pullback_pattern' as label_source, sub as label_subtype,
  1.0::double as confidence, concat(ts_code, '_', cast(trade_date as varchar), '_pullback') as event_id, hdate as recent_high_date, hi as recent_high,
  days as days_since_high, lo as lookback_low, rise as rise_into_high_pct, close as current_close, vol as current_volume, close / hi - 1 as drawdown_from_high,
  depth as pullback_depth_pct, speed as pullback_speed_pct_per_day, ma5_distance, ma20_distance, ma60_distance, volatility_20d, volume_ratio_20,
  cast(null as double) as turnover_ratio, case sub when 'no_prior_rise' then sub when 'no_pullback' then 'prior_rise;no_meaningful_pullback'
    when 'simple_pullback' then 'prior_rise;has_pullback;pullback_depth_ok;days_since_high_ok;pullback_speed_ok'
    else concat('prior_rise;has_pullback;', sub) end as rule_flags, columns('diagnostic_.*') from pulls"""
PULL_NUMS = (
    "confidence recent_high lookback_low rise_into_high_pct current_close current_volume drawdown_from_high pullback_depth_pct "
    "pullback_speed_pct_per_day ma5_distance ma20_distance ma60_distance volatility_20d volume_ratio_20 turnover_ratio "
    + " ".join(f"diagnostic_future_{k}_return_{n}d" for n in (5, 10, 20) for k in ("max", "min", "close"))
)
DEFAULT_PULL, FAST_PULL = (0.10, 0.03, 0.25, 40, 0.0), (0.15, 0.06, 0.22, 10, 0.008)


def pull_oracle(params, where: str = "true") -> str:
    return oracle(f"{PULL_SELECT} where {where}", pull_sql(*params), dates="asof_date recent_high_date", nums=PULL_NUMS, ints="label days_since_high")


@query("pullback_samples", pull_oracle(DEFAULT_PULL))
def _pull(spark, sf):
    return pb.pullback_samples(load_bars(spark, sf))


@query("pullback_fastdrop_negatives", pull_oracle(FAST_PULL, "sub <> 'simple_pullback'"))
def _pull_neg(spark, sf):
    return pb.pullback_negatives(load_bars(spark, sf), pb.FASTDROP)


@query("pullback_latest", pull_oracle(DEFAULT_PULL, "rn = nb"))
def _pull_latest(spark, sf):
    return pb.pullback_job(load_bars(spark, sf), latest_only=True)


@query(
    "pullback_strided_range",
    pull_oracle(
        DEFAULT_PULL,
        "trade_date between '1998-01-01' and '2000-12-31' and (rn - (select min(x.rn) from pr x where x.ts_code = pulls.ts_code and x.rn >= 90 and x.trade_date >= '1998-01-01')) % 7 = 0",
    ),
)
def _pull_range(spark, sf):
    return pb.pullback_job(load_bars(spark, sf), start_date="1998-01-01", end_date="2000-12-31", stride=7)


W_SQL = """
wi as (select *, row_number() over (partition by ts_code order by trade_date) as i, count(*) over (partition by ts_code) as n,
  min(close) over (partition by ts_code order by trade_date rows between 5 preceding and 5 following) as lo5,
  max(close) over (partition by ts_code order by trade_date rows between 5 preceding and 5 following) as hi5,
  avg(vol) over (partition by ts_code order by trade_date rows 19 preceding) as v20,
  lag(close) over (partition by ts_code order by trade_date) as c1, lag(close, 3) over (partition by ts_code order by trade_date) as c3 from bars),
ww as (select * from (values ('short', 120), ('medium', 252), ('long', 504)) t(window_name, len)),
wl as (select w.window_name, w.len, x.ts_code, x.i, x.close, x.trade_date, x.n from wi x join ww w on x.n >= w.len
  where x.i > x.n - w.len + 5 and x.i <= x.n - 5 and x.close = x.lo5),
wh as (select a.*, (select max(b.close) from wi b where b.ts_code = a.ts_code and b.i > a.n - a.len and b.i < a.i) as h from wl a),
w1 as (select * from wh where (h - close) / h >= 0.20),
w2 as (select a.*, b.i as i2, b.close as c2, b.trade_date as d2 from w1 a join wl b on b.ts_code = a.ts_code and b.window_name = a.window_name
  and b.i - a.i between 20 and 300 and b.i <= a.n - 5 and abs(b.close / a.close - 1) <= 0.12 and b.close >= a.close * 0.90),
w3 as (select a.*, coalesce((select max(p.close) from wi p where p.ts_code = a.ts_code and p.i > a.i and p.i < a.i2 and p.close = p.hi5
    and p.i > a.n - a.len + 5 and p.i <= a.n - 5), (select max(p.close) from wi p where p.ts_code = a.ts_code and p.i > a.i and p.i < a.i2)) as m,
  (select count(*) from wi p where p.ts_code = a.ts_code and p.i > a.i and p.i < a.i2 and p.close = p.hi5 and p.i > a.n - a.len + 5 and p.i <= a.n - 5) as peaks from w2 a),
w4 as (select a.*, z.trade_date as asof_date, z.close as now, z.vol / nullif(z.v20, 0) as vr, z.close / z.c1 - 1 as ret_1d, z.close / z.c3 - 1 as ret_3d,
  (h - a.close) / h as dd, abs(c2 / a.close - 1) as sim, (m - a.close) / a.close as reb, (m - z.close) / m as dist, z.close >= m as brk
  from w3 a join wi z on z.ts_code = a.ts_code and z.i = z.n where (m - a.close) / a.close >= 0.08 and z.close >= m * 0.92),
w5 as (select *, case when brk then 'w_bottom_breakout' else 'w_bottom_forming' end as stage,
  round(least(1, dd / 0.4) * 0.20 + (1 - sim / 0.12) * 0.25 + least(1, reb / 0.16) * 0.20
    + (case when brk then 1 else greatest(0, least(1, 1 - greatest(dist, 0) / 0.08)) end) * 0.25 + (case when brk and vr >= 1.2 then 0.10 else 0 end), 6) as score from w4),
w6 as (select *, row_number() over (partition by ts_code, window_name, stage order by score desc, i, i2) as k from w5),
w7 as (select *, (select min(p.i) from wi p where p.ts_code = w6.ts_code and p.i > w6.n - w6.len and p.i < w6.i and p.close = w6.h) as hi_i,
  (select min(p.i) from wi p where p.ts_code = w6.ts_code and p.i > w6.i and p.i < w6.i2 and p.close = w6.m and
    (w6.peaks = 0 or (p.close = p.hi5 and p.i > w6.n - w6.len + 5 and p.i <= w6.n - 5))) as m_i from w6 where k = 1)
"""


@query(
    "mine_w_bottom",
    oracle(
        """select concat(w.ts_code, '_', cast(asof_date as varchar), '_w_bottom_', window_name, '_', stage) as sample_id, w.ts_code, asof_date, 1 as label,
           'rule_w_bottom' as label_source, 0.6::double as confidence, concat(w.ts_code, '_', cast(asof_date as varchar), '_w_bottom_', window_name, '_', stage) as event_id,
           'w_bottom' as miner_name, score as candidate_score, now as close, ret_1d, ret_3d, vr as vol_ratio_1d, len as base_window_days,
           (h - least(w.close, c2)) / least(w.close, c2) as base_range_pct, brk as breakout_flag,
           concat_ws(';', 'prior_drawdown_ok;bottom_similarity_ok;middle_rebound_ok;neckline_ok', stage, printf('prior_drawdown=%.3f', dd), printf('bottom_similarity=%.3f', sim),
             printf('middle_rebound=%.3f', reb), printf('neckline_distance=%.3f', dist), printf('volume_ratio_20=%.3f', vr), case when brk and vr >= 1.2 then 'volume_breakout_ok' end) as rule_flags,
           window_name as "window", stage as pattern_stage, w.trade_date as left_bottom_date, w.close as left_bottom_price, pm.trade_date as middle_peak_date, m as neckline_price,
           d2 as right_bottom_date, c2 as right_bottom_price, ph.trade_date as prior_high_date, h as prior_high_price, sim as bottom_similarity_pct, reb as middle_rebound_pct,
           dd as prior_drawdown_pct, dist as neckline_distance_pct, vr as volume_ratio_20 from w7 w join wi pm on pm.ts_code = w.ts_code and pm.i = m_i join wi ph on ph.ts_code = w.ts_code and ph.i = hi_i""",
        W_SQL, dates="asof_date left_bottom_date middle_peak_date right_bottom_date prior_high_date",
        nums="confidence candidate_score close ret_1d ret_3d vol_ratio_1d base_range_pct left_bottom_price neckline_price right_bottom_price prior_high_price bottom_similarity_pct middle_rebound_pct prior_drawdown_pct neckline_distance_pct volume_ratio_20",
        ints="label base_window_days",
    ),
)
def _w_bottom(spark, sf):
    return bases.w_bottom(load_bars(spark, sf))


BASE_CFG = bases.BottomBase(
    scan=bases.ScanRows(asof_stride=5, min_asof_date=None), windows=(bases.Lookback("short", 120), bases.Lookback("medium", 252), bases.Lookback("long", 504))
)
LONG_CFG = bases.LongBase(
    scan=bases.ScanRows(asof_stride=2, min_asof_date=None, max_candidates_per_symbol=80, min_days_between_candidates=60),
    windows=(bases.Lookback("one_year", 252), bases.Lookback("two_year", 504)),
    max_neckline_to_prior_high_ratio=0.97, min_base_duration_bars=200,
)


@query("mine_bottom_base_breakout")
def _bottom_base(spark, sf):
    return bases.bottom_base_breakout(load_bars(spark, sf), BASE_CFG)


@query("mine_long_base_breakout")
def _long_base(spark, sf):
    return bases.long_base_breakout(load_bars(spark, sf), LONG_CFG)


@query("long_base_monthly_gate")
def _long_monthly(spark, sf):
    from dataclasses import replace

    cfg = replace(LONG_CFG, monthly=bases.MonthlyTrend(enable=True, min_ma_slope_pct=-0.5, min_lookback_return_pct=-0.9, min_close_vs_ma_pct=-0.5))
    return bases.long_base_breakout(load_bars(spark, sf), cfg)


@query(
    "monthly_trend",
    oracle(
        """select s.ts_code, s.trade_date as asof_date, k as monthly_trend_months, s.close / m24 - 1 as monthly_trend_return_pct,
           case when k >= 12 then (before + s.close) / 12 end / pma - 1 as monthly_trend_ma_slope_pct, s.close / case when k >= 12 then (before + s.close) / 12 end - 1 as monthly_close_vs_ma_pct
           from bars s join mo on mo.ts_code = s.ts_code and mo.month = date_trunc('month', s.trade_date)""",
        """m0 as (select ts_code, date_trunc('month', trade_date) as month, arg_max(close, trade_date) as mc from bars group by 1, 2),
           mo as (select *, row_number() over w as k, lag(mc, 24) over w as m24,
             sum(mc) over (partition by ts_code order by month rows between 11 preceding and 1 preceding) as before,
             case when count(*) over (partition by ts_code order by month rows between 17 preceding and 6 preceding) = 12 then
               avg(mc) over (partition by ts_code order by month rows between 17 preceding and 6 preceding) end as pma from m0 window w as (partition by ts_code order by month))""",
        dates="asof_date", nums="monthly_trend_return_pct monthly_trend_ma_slope_pct monthly_close_vs_ma_pct", ints="monthly_trend_months",
    ),
)
def _monthly(spark, sf):
    b = load_bars(spark, sf)
    rows = b.select("ts_code", F.col("trade_date").alias("asof_date"), F.col("close").alias("now"))
    return bases.monthly_trend(rows, b, bases.MonthlyTrend()).drop("now")


@query(
    "breakout_prefilter",
    oracle(
        f"""select ts_code, trade_date, nk as neckline, close / nk - 1 as distance from (select *, {roll('max', 'close', 45, 15)} as nk from bars) where close / nk - 1 > 0 and close / nk - 1 <= 0.08""",
        dates="trade_date", nums="neckline distance",
    ),
)
def _prefilter(spark, sf):
    return bases.prefilter(load_bars(spark, sf), 45, 15, 0.0, 0.08).select("ts_code", "trade_date", "neckline", "distance")


TAIL_SQL = """ti as (select *, row_number() over (partition by ts_code order by trade_date) as i, count(*) over (partition by ts_code) as n from bars),
tail as (select *, i - (n - 120) as o from ti where n >= 120 and i > n - 120),
tn as (select ts_code, max(close) as nk from tail where o > 60 and o <= 105 group by ts_code),
tk as (select t.ts_code, min(t.o) as nk_o, any_value(nk) as nk from tail t join tn using (ts_code) where o > 60 and o <= 105 and close = nk group by t.ts_code)"""


def tails(spark, sf):
    b = bases.clean_bars(load_bars(spark, sf))
    last = b.where("rn = n_bars and rn >= 120").select("ts_code", "rn", F.lit(120).alias("len"))
    return bases.attach_windows(last, b, 120)


@query(
    "base_neckline_and_crossing",
    oracle(
        """select k.ts_code, d.trade_date as neckline_date, k.nk as neckline_price, b.trade_date as breakout_date from tk k join tail d on d.ts_code = k.ts_code and d.o = k.nk_o
           left join (select x.ts_code, min(x.o) as o from tail x join tk using (ts_code) join tail p on p.ts_code = x.ts_code and p.o = x.o - 1
             where x.o > tk.nk_o and x.close > tk.nk and p.close <= tk.nk group by x.ts_code) c on c.ts_code = k.ts_code left join tail b on b.ts_code = c.ts_code and b.o = c.o""",
        TAIL_SQL, dates="neckline_date breakout_date", nums="neckline_price",
    ),
)
def _neckline(spark, sf):
    t = bases.step(tails(spark, sf), base=F.slice("w", 61, 60))
    t = bases.step(t, nk=bases.neckline_of_base(F.col("base"), 15, F.lit(60)))
    t = bases.step(t, brk=bases.first_crossing(F.col("w"), F.col("nk.i"), F.col("nk.v")))
    return t.select("ts_code", bases._bar_at(F.col("nk.i"))["d"].alias("neckline_date"), F.col("nk.v").alias("neckline_price"), bases._bar_at(F.col("brk"))["d"].alias("breakout_date"))


@query(
    "band_neckline",
    oracle(
        """select ts_code, case when best is not null then best when q85 between lo and hi then near end as neckline_price from (
           select r.ts_code, any_value(lo) as lo, any_value(hi) as hi, max(case when close between lo and hi then close end) as best, any_value(q85) as q85,
             arg_min(close, abs(close - q85) * 1000000 + o * 0.0000001) as near from tail r join rng using (ts_code) where o > 10 group by r.ts_code)""",
        TAIL_SQL + """, rng as (select ts_code, quantile_cont(close, 0.10) * 1.15 as lo, max(high) * 0.80 as hi, quantile_cont(close, 0.85) filter (where o > 10) as q85 from tail group by ts_code)""",
        nums="neckline_price",
    ),
)
def _band(spark, sf):
    t = tails(spark, sf)
    t = bases.step(t, lo=bases.array_quantile(F.transform("w", lambda x: x["c"]), 0.10) * 1.15, hi=F.array_max(F.transform("w", lambda x: x["h"])) * 0.80)
    t = bases.step(t, nk=bases.neckline_in_band(F.slice("w", 11, 110), F.col("lo"), F.col("hi")))
    return t.select("ts_code", F.col("nk.v").alias("neckline_price"))


@query(
    "support_touches",
    oracle(
        "select ts_code, count(*) as touches, string_agg(cast(trade_date as varchar), ',' order by o) as dates from chosen join tail using (ts_code, o) group by ts_code",
        TAIL_SQL + """, zn as (select ts_code, quantile_cont(close, 0.10) * 1.15 as zone from tail group by ts_code),
          hit as (select t.ts_code, t.o from tail t join zn using (ts_code) where t.close <= zone),
          chosen as (select ts_code, min(o) as o from hit group by ts_code union all
            select c.ts_code, (select min(h.o) from hit h where h.ts_code = c.ts_code and h.o >= c.o + 20) from chosen c
            where exists (select 1 from hit h where h.ts_code = c.ts_code and h.o >= c.o + 20))""",
        ints="touches",
    ).replace("with bar_d", "with recursive bar_d", 1),
)
def _touches(spark, sf):
    """Touches of the 10 percent zone at least 20 bars apart in each symbol's last 120 bars (fold over one window)."""
    t = tails(spark, sf)
    t = bases.step(t, zone=bases.array_quantile(F.transform("w", lambda x: x["c"]), 0.10) * 1.15)
    t = bases.step(t, touch=bases.separated_touches(F.filter("w", lambda x: x["c"] <= F.col("zone")), 20))
    return t.select("ts_code", F.size("touch").alias("touches"), F.array_join(F.transform("touch", lambda x: x["d"].cast("string")), ",").alias("dates"))


@query(
    "spaced_selection",
    oracle(
        """select sample_id, ts_code, d as asof_date, s as candidate_score from (select w.*, row_number() over (partition by w.ts_code order by k) as pos from walk w join
           (select ts_code, arg_max(kept, k) as kept from st group by ts_code) f using (ts_code) where list_contains(f.kept, w.d)) where pos <= 5""",
        HITS_SQL + """, walk as (select sample_id, ts_code, anchor_date as d, phase1_score_mean as s, row_number() over (partition by ts_code order by phase1_score_mean desc, anchor_date, sample_id) as k from hits),
          st as (select ts_code, k, [d] as kept from walk where k = 1 union all
            select w.ts_code, w.k, case when len(list_filter(st.kept, lambda x: abs(date_diff('day', x, w.d)) < 30)) = 0 then list_append(st.kept, w.d) else st.kept end
            from st join walk w on w.ts_code = st.ts_code and w.k = st.k + 1)""",
        dates="asof_date", nums="candidate_score",
    ).replace("with bar_d", "with recursive bar_d", 1),
)
def _spaced(spark, sf):
    """Phase-1 hits of each symbol at least 30 days apart, best first (ordered fold per symbol)."""
    h = hits(spark, sf).select("sample_id", "ts_code", F.col("anchor_date").alias("asof_date"), F.col("phase1_score_mean").alias("candidate_score"))
    return sel.spaced_selection(h, ["ts_code"], 30, 5)


LEG_SQL = f"""lb as (select *, (close / lag(close) over w - 1) * 100 as pct_chg, row_number() over w as rn, count(*) over (partition by ts_code) as nb from bars window w as (partition by ts_code order by trade_date)),
lc as (select *, {roll('avg', 'close', 10)} as ma10, {roll('avg', 'close', 20)} as ma20, {roll('avg', 'vol', 20)} as vma20, {roll('max', 'high', 100, 1, 1)} as bh, {roll('min', 'low', 100, 1, 1)} as bl,
  {roll('avg', 'vol', 100, 1, 1)} as bm, {roll('stddev_samp', 'vol', 100, 1, 1)} as bs, {roll('avg', 'vol', 20, 1, 1)} as b20, {roll('max', 'high', 90, 1, 1)} as plat from lb),
li as (select *, bh / (bl + 1e-9) - 1 as br, bs / (bm + 1e-9) as cv, vol / (b20 + 1e-9) as vr from lc where nb >= 160),
lm as (select ts_code, max(rn) as irn from li where rn > nb - 20 and rn > 100 and br <= 0.9 and cv <= 0.95 and b20 / (bm + 1e-9) <= 1.2 and pct_chg >= 2 and vr >= 1.0 and close > plat * 0.98 group by ts_code),
ls as (select l.*, m.irn, max(l.high) over (partition by l.ts_code) as top from li l join lm m using (ts_code) where rn >= irn),
lt as (select *, min(case when high = top then rn end) over (partition by ts_code) as trn from ls),
lg as (select ts_code, max(case when rn = nb then trade_date end) as trade_date, max(case when rn = nb then close end) as c, max(case when rn = nb then ma10 end) as ma10, max(case when rn = nb then ma20 end) as ma20,
  max(case when rn = irn then trade_date end) as impulse_date, max(case when rn = irn then close end) as ic, max(case when rn = irn then vol end) as iv, max(case when rn = irn then pct_chg end) as ip,
  max(case when rn = irn then vr end) as ivr, max(case when rn = irn then plat end) as plat, max(case when rn = irn then br end) as br, max(case when rn = irn then cv end) as cv, max(top) as top,
  count(*) filter (where rn > trn) as pd, count(*) as n, avg(case when rn > trn then vol end) as pv, bool_or(rn > nb - 2 and pct_chg > 7 and vol > vma20 * 2) as heavy from lt group by ts_code),
lf as (select *, (top - c) / (top + 1e-9) as depth, pv / (iv + 1e-9) as pvr from lg)"""
LEG_CFG = legacy.TwoLegConfig(
    base_max_range_pct=0.9, base_max_vol_cv=0.95, base_vol_shrink_ratio_max=1.2, min_impulse_pct=0.02, min_impulse_vol_ratio=1.0,
    max_pullback_days=15, max_post_bars=19, max_pullback_pct=0.30, max_pullback_vol_ratio=1.5, max_close_below_breakout_close=0.25,
    min_above_ma10_ratio=0.8, min_above_platform_ratio=0.6, max_price=500.0, min_price=1.0,
)


@query(
    "legacy_two_leg",
    oracle(
        """select ts_code, trade_date, round(c, 2) as close, impulse_date, round(ip, 2) as impulse_pct_chg, round(ivr, 2) as impulse_vol_ratio, round(top, 2) as first_leg_high, round(depth * 100, 2) as pullback_pct,
           pd as pullback_days, round(pvr, 2) as pullback_vol_ratio, round(ma10, 2) as ma10, round(ma20, 2) as ma20, round(plat, 2) as platform_high_before,
           round(greatest(0, 20 - br * 40) + greatest(0, 20 - cv * 20) + least(20, ivr * 4) + greatest(0, 20 - depth * 100) + greatest(0, 20 - pvr * 20), 2) as score from lf
           where c between 1 and 500 and n - 1 between 2 and 19 and pd between 2 and 15 and depth between 0.03 and 0.30 and pvr <= 1.5 and c >= ic * 0.75 and c >= ma10 * 0.8 and c >= plat * 0.6 and c < top * 0.98 and not heavy""",
        LEG_SQL, dates="trade_date impulse_date", nums="close impulse_pct_chg impulse_vol_ratio first_leg_high pullback_pct pullback_vol_ratio ma10 ma20 platform_high_before score", ints="pullback_days",
    ),
)
def _two_leg(spark, sf):
    b = load_bars(spark, sf).withColumn("pct_chg", BARS.pct("close") * 100)
    return legacy.two_leg(b, LEG_CFG)


@query(
    "legacy_indicators",
    oracle(
        f"""select ts_code, trade_date, {roll('avg', 'close', 30)} as ma30, {roll('avg', 'vol', 60)} as vma60, {roll('avg', 'tr', 14)} as atr14, {roll('max', 'high', 90, 1)} as hhv90_prev,
            ({roll('max', 'high', 100)} - {roll('min', 'low', 100)}) / ({roll('min', 'low', 100)} + 1e-9) as base_range_pct_100,
            ({roll('stddev_samp', 'vol', 100)}) / ({roll('avg', 'vol', 100)} + 1e-9) as vol_cv_100, ({roll('avg', 'vol', 20)}) / ({roll('avg', 'vol', 100)} + 1e-9) as vol_shrink_ratio from t""",
        """t as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr from (select * replace (close * 1.0471975511965976::double as close, vol * 1.0471975511965976::double as vol) from bars) window w as (partition by ts_code order by trade_date))""",
        dates="trade_date", nums="ma30 vma60 atr14 hhv90_prev base_range_pct_100 vol_cv_100 vol_shrink_ratio",
    ),
)
def _indicators(spark, sf):
    k = F.lit(1.0471975511965976)
    b = load_bars(spark, sf).withColumns({"close": F.col("close") * k, "vol": F.col("vol") * k})
    return indicators(b).select("ts_code", "trade_date", "ma30", "vma60", "atr14", "hhv90_prev", "base_range_pct_100", "vol_cv_100", "vol_shrink_ratio")


@query(
    "candidate_global_order",
    oracle(
        f"select *, row_number() over (order by candidate_score desc, asof_date desc, ts_code) as k from ({spec_sql('type_n')[1]}) order by k limit 200",
        PANEL_SQL, dates="asof_date", nums=NUMS, ints="k",
    ),
)
def _global_order(spark, sf):
    from barloom.functions.ordering import with_global_rank

    c = mine_many(load_bars(spark, sf), {"type_n": {}}, max_total=200)
    return with_global_rank(c, mn.candidate_order(), "k")


@query(
    "miner_run_job",
    oracle(
        f"""select {', '.join(COLS.split())} from (select *, row_number() over (partition by miner_name order by candidate_score desc, asof_date desc, ts_code) as g
            from (({spec_sql('downtrend_rebound')[1]}) union all ({spec_sql('volume_only_spike')[1]})) where ts_code in ('S000001', 'S000002', 'S000003')) where g <= 8""",
        PANEL_SQL, dates="asof_date", nums=NUMS,
    ),
)
def _run_job(spark, sf):
    cfg = {n: {"max_candidates_total": 8} for n in ("downtrend_rebound", "volume_only_spike")}
    return mine_many(load_bars(spark, sf), cfg, symbols="S000001,S000002,S000003", per_miner_total=True)


@query(
    "candidate_distribution",
    oracle(
        f"select miner_name, year(asof_date) as year, count(*) as row_count from ({' union all '.join(f'({spec_sql(n)[1]})' for n in ('type_n', 'steady_uptrend'))}) group by 1, 2",
        PANEL_SQL, ints="year row_count",
    ),
)
def _distribution(spark, sf):
    c = mn.scan_thresholds(load_bars(spark, sf), {n: mn.THRESHOLD_MINERS[n][0]() for n in ("type_n", "steady_uptrend")})
    return sel.distribution(c, F.col("miner_name"), F.year("asof_date").alias("year"))


@query(
    "top_per_symbol",
    oracle(
        "select sample_id, ts_code, score from (select *, row_number() over (partition by ts_code order by score desc, sample_id) as k from pred_a) where k <= 3",
        PREDS_SQL, nums="score",
    ),
)
def _top_symbol(spark, sf):
    p = pred(spark, sf, 7.13).select("sample_id", "ts_code", "score")
    return sel.top_per_group(p, ["ts_code"], [F.desc("score"), F.asc("sample_id")], 3)


@query(
    "best_per_group",
    oracle(
        "select ts_code, year, sample_id, score from (select *, year(asof_date) as year, row_number() over (partition by ts_code, year(asof_date) order by score desc, sample_id) as k from pred_a) where k = 1",
        PREDS_SQL, nums="score", ints="year",
    ),
)
def _best(spark, sf):
    p = pred(spark, sf, 7.13).select("ts_code", F.year("asof_date").alias("year"), "sample_id", "score")
    return sel.best_per_group(p, ["ts_code", "year"], [F.desc("score"), F.asc("sample_id")])


@query("phase1_top_per_date", oracle("select * from hits", HITS_SQL, dates="anchor_date", nums="phase1_score_lgbm phase1_score_xgb phase1_score_mean phase1_score_min", ints="phase1_rank"))
def _phase1_top(spark, sf):
    return hits(spark, sf)


@query(
    "select_top",
    oracle("select sample_id, ts_code, score from pred_a order by score desc, sample_id limit 50", PREDS_SQL, nums="score"),
)
def _select_top(spark, sf):
    p = pred(spark, sf, 7.13).select("sample_id", "ts_code", "score")
    return sel.select_candidates(p, top_n=50, score="score")


@query(
    "select_random",
    oracle("select * from pred_a order by md5(concat('7|', sample_id)), sample_id limit 50", PREDS_SQL, dates="asof_date", nums="score", ints="y_true"),
)
def _select_random(spark, sf):
    """Repeatable random choice by hash order."""
    return sel.select_candidates(pred(spark, sf, 7.13), top_n=50, sample="random", score="score", seed=7)


YEAR_SQL = PREDS_SQL + ", yr as (select sample_id, asof_date, score, year(asof_date) as sample_year, row_number() over (partition by year(asof_date) order by score desc, sample_id) as year_rank from pred_a)"


@query(
    "select_year_stratified",
    oracle("select * from yr order by year_rank, sample_year limit 40", YEAR_SQL, dates="asof_date", nums="score", ints="sample_year year_rank"),
)
def _select_year(spark, sf):
    p = pred(spark, sf, 7.13).select("sample_id", "asof_date", "score")
    return sel.select_candidates(p, top_n=40, sample="year_stratified", score="score")


@query("year_stratified_all", oracle("select * from yr", YEAR_SQL, dates="asof_date", nums="score", ints="sample_year year_rank"))
def _select_year_all(spark, sf):
    p = pred(spark, sf, 7.13).select("sample_id", "asof_date", "score")
    return sel.select_candidates(p, top_n=0, sample="year_stratified", score="score")

