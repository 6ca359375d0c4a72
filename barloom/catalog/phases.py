"""Two-phase tracking stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.views import HITS_SQL, frac, hits
from barloom.operators import calendar as cal
from barloom.plans import tracking as tk
from barloom.session import stored
from barloom.sources.bars import load_bars
from barloom.sources.universe import dense_dates


def targets(spark, sf):
    """Every trading date."""
    d = dense_dates(load_bars(spark, sf))
    return d, d.select(F.col("date").alias("target_date"))


def staged(spark, sf):
    d, t = targets(spark, sf)
    anchors = cal.anchor_dates(d, t, 15)
    h = tk.hits_for_targets(hits(spark, sf), anchors)
    return anchors, h, tk.stock_pool(h)


STAGE_SQL = HITS_SQL + """, tgt as (select date as target_date, pos as tpos from all_dates),
anc as (select target_date, date as anchor_date from tgt join all_dates on pos between tpos - 15 and tpos - 1),
th as (select a.target_date, h.* from hits h join anc a using (anchor_date)),
tf as (select *, row_number() over (partition by target_date, ts_code order by anchor_date, phase1_rank) as kf, row_number() over (partition by target_date, ts_code order by anchor_date desc, phase1_rank desc) as kl,
  row_number() over (partition by target_date, ts_code order by phase1_score_mean desc, phase1_score_min desc, anchor_date, phase1_rank) as kb from th),
pool as (select target_date, ts_code, max(anchor_date) filter (where kf = 1) as pool_entry_date, max(phase1_rank) filter (where kf = 1) as phase1_rank, max(phase1_score_lgbm) filter (where kf = 1) as phase1_score_lgbm,
  max(phase1_score_xgb) filter (where kf = 1) as phase1_score_xgb, max(phase1_score_mean) filter (where kf = 1) as phase1_score_mean, max(phase1_score_min) filter (where kf = 1) as phase1_score_min, count(*) as phase1_seen_count,
  string_agg(cast(anchor_date as varchar), ';' order by anchor_date) as phase1_seen_dates, max(anchor_date) filter (where kl = 1) as last_seen_phase1_date, max(phase1_rank) filter (where kl = 1) as latest_phase1_rank,
  max(phase1_score_lgbm) filter (where kl = 1) as latest_phase1_score_lgbm, max(phase1_score_xgb) filter (where kl = 1) as latest_phase1_score_xgb, max(phase1_score_mean) filter (where kl = 1) as latest_phase1_score_mean,
  max(phase1_score_min) filter (where kl = 1) as latest_phase1_score_min, max(anchor_date) filter (where kb = 1) as best_phase1_date, max(phase1_rank) filter (where kb = 1) as best_phase1_rank,
  max(phase1_score_mean) filter (where kb = 1) as best_phase1_score_mean, 'first_entry_per_stock' as pool_policy from tf group by target_date, ts_code)"""
POOL_DATES = "target_date pool_entry_date last_seen_phase1_date best_phase1_date"
POOL_NUMS = "phase1_score_lgbm phase1_score_xgb phase1_score_mean phase1_score_min latest_phase1_score_lgbm latest_phase1_score_xgb latest_phase1_score_mean latest_phase1_score_min best_phase1_score_mean"
POOL_INTS = "phase1_rank phase1_seen_count latest_phase1_rank best_phase1_rank"


@query("stock_pool", oracle("select * from pool", STAGE_SQL, dates=POOL_DATES, nums=POOL_NUMS, ints=POOL_INTS))
def _pool(spark, sf):
    return staged(spark, sf)[2]


@query(
    "normalized_pool",
    oracle(
        """select target_date, ts_code, '' as name, pool_entry_date as first_phase1_date, last_seen_phase1_date as last_phase1_date, phase1_seen_count as phase1_hit_count, phase1_seen_dates, best_phase1_date, best_phase1_score_mean,
           latest_phase1_score_mean, latest_phase1_rank, 'in_pool' as pool_status from pool""",
        STAGE_SQL, dates="target_date first_phase1_date last_phase1_date best_phase1_date", nums="best_phase1_score_mean latest_phase1_score_mean", ints="phase1_hit_count latest_phase1_rank",
    ),
)
def _normalized(spark, sf):
    p = tk.normalized_pool(staged(spark, sf)[2])
    return p.select("target_date", "ts_code", "name", "first_phase1_date", "last_phase1_date", "phase1_hit_count", "phase1_seen_dates", "best_phase1_date",
                    "best_phase1_score_mean", "latest_phase1_score_mean", "latest_phase1_rank", "pool_status")


@query(
    "missing_anchor_dates",
    oracle("select target_date, anchor_date from anc where anchor_date not in (select anchor_date from hits where day(anchor_date) <> 7)", STAGE_SQL, dates="target_date anchor_date"),
)
def _missing(spark, sf):
    anchors = staged(spark, sf)[0]
    return tk.missing_anchor_dates(hits(spark, sf).where(F.dayofmonth("anchor_date") != 7), anchors).select("target_date", "anchor_date")


@query(
    "price_paths",
    oracle(
        """select target_date, ts_code, pool_entry_date, n - 1 as days_since_anchor, first as anchor_close, last as current_close, last / first - 1 as current_return_from_anchor, top / first - 1 as max_runup_since_anchor,
           last / top - 1 as drawdown_from_post_anchor_high, bottom / first - 1 as min_low_return_from_anchor from spans where first is not null and last is not null""",
        STAGE_SQL + """, spans as (select p.target_date, p.ts_code, p.pool_entry_date, count(*) as n, max(b.close) filter (where b.trade_date = p.pool_entry_date) as first, max(b.close) filter (where b.trade_date = p.target_date) as last,
           max(b.high) as top, min(b.low) as bottom from pool p join bars b on b.ts_code = p.ts_code and b.trade_date between p.pool_entry_date and p.target_date group by p.target_date, p.ts_code, p.pool_entry_date)""", dates="target_date pool_entry_date", nums="anchor_close current_close current_return_from_anchor max_runup_since_anchor drawdown_from_post_anchor_high min_low_return_from_anchor", ints="days_since_anchor",
    ),
)
def _paths(spark, sf):
    p = tk.price_paths(staged(spark, sf)[2], load_bars(spark, sf))
    return p.select("target_date", "ts_code", "pool_entry_date", "days_since_anchor", "anchor_close", "current_close", "current_return_from_anchor",
                    "max_runup_since_anchor", "drawdown_from_post_anchor_high", "min_low_return_from_anchor")


def bar_scores(spark, sf):
    """Pseudo phase-2 scores for every bar."""
    b = load_bars(spark, sf).select("ts_code", F.col("trade_date").alias("asof_date"), frac("close", 5.31).alias("phase2_score_lgbm"), frac("close", 9.77).alias("phase2_score_xgb"))
    return tk.with_pair(b, "phase2")


SCORE_SQL = STAGE_SQL + """, bs0 as (select ts_code, trade_date as asof_date, round(close * 5.31::double - floor(close * 5.31::double), 6) as phase2_score_lgbm, round(close * 9.77::double - floor(close * 9.77::double), 6) as phase2_score_xgb from bars),
bs as (select *, (phase2_score_lgbm + phase2_score_xgb) / 2 as phase2_score_mean, least(phase2_score_lgbm, phase2_score_xgb) as phase2_score_min from bs0)"""


@query(
    "pool_score_rows",
    oracle(
        """select p.pool_entry_date as anchor_date, p.ts_code, c.trade_date as asof_date, concat(p.ts_code, '_', cast(p.pool_entry_date as varchar)) as event_id, concat(p.ts_code, '_', cast(c.trade_date as varchar)) as sample_id, c.close / a.close - 1 as current_return_from_anchor,
           s.phase2_score_mean, s.phase2_score_min from pool p join bars a on a.ts_code = p.ts_code and a.trade_date = p.pool_entry_date join all_dates d0 on d0.date = p.pool_entry_date
           cross join range(1, 13) r(k) join all_dates d1 on d1.pos = d0.pos + r.k join bars c on c.ts_code = p.ts_code and c.trade_date = d1.date left join bs s on s.ts_code = p.ts_code and s.asof_date = c.trade_date""",
        SCORE_SQL, dates="anchor_date asof_date", nums="current_return_from_anchor phase2_score_mean phase2_score_min",
    ),
)
def _score_rows(spark, sf):
    d, _ = targets(spark, sf)
    pool = staged(spark, sf)[2]
    dates = cal.track_dates(d, pool.select(F.col("pool_entry_date").alias("anchor_date")).distinct(), 12)
    rows = tk.pool_score_rows(pool, load_bars(spark, sf), bar_scores(spark, sf), dates)
    return rows.select("anchor_date", "ts_code", "asof_date", "event_id", "sample_id", "current_return_from_anchor", "phase2_score_mean", "phase2_score_min")


def target_scores(spark, sf, pool):
    """Pseudo phase-2 scores of the pool's stocks on their target dates, from the last bar on or before it."""
    from barloom.operators.asof import asof_join

    keys = pool.select("ts_code", "target_date", F.col("target_date").alias("asof_date"))
    s = asof_join(keys, bar_scores(spark, sf), "asof_date", "ts_code", bounded=True)
    return s.withColumn("sample_id", F.concat_ws("_", "ts_code", F.date_format("target_date", "yyyy-MM-dd")))


TSC_SQL = SCORE_SQL + """, ts2 as (select p.ts_code, p.target_date, s.phase2_score_lgbm, s.phase2_score_xgb, s.phase2_score_mean, s.phase2_score_min from pool p asof join bs s on s.ts_code = p.ts_code and p.target_date >= s.asof_date),
trend as (select ts_code, trade_date, avg(close) over w60 as m60, count(*) over w60 as n60, high from bars window w60 as (partition by ts_code order by trade_date rows 59 preceding)),
trs as (select ts_code, trade_date, case when n60 = 60 then m60 end as m, lag(case when n60 = 60 then m60 end, 20) over (partition by ts_code order by trade_date) as mb from trend)"""
# a lowest factor of few digits would put products of six-digit scores on the edge of rounding
TREND_CFG = {"midlong_trend": {"enabled": True, "min_factor": 0.25371, "score_col": "phase2_score_mean", "output_score_col": "adjusted_phase2_score"}}


@query(
    "phase2_reviewed",
    oracle(
        """select t.target_date, t.ts_code, phase2_score_mean, p.phase1_seen_count as phase1_hit_count, phase2_score_mean * (0.25371 + (1.35 - 0.25371) * case when m / mb - 1 is null then 0 else 1 / (1 + exp(greatest(-60, least(60, -80 * (m / mb - 1))))) end) as adjusted_phase2_score
           from ts2 t join pool p using (target_date, ts_code) asof left join trs r on r.ts_code = t.ts_code and t.target_date >= r.trade_date""",
        TSC_SQL, dates="target_date", nums="phase2_score_mean adjusted_phase2_score", ints="phase1_hit_count",
    ),
)
def _reviewed(spark, sf):
    pool = tk.normalized_pool(staged(spark, sf)[2])
    out = tk.review_phase2(target_scores(spark, sf, pool), pool, load_bars(spark, sf), TREND_CFG)
    return out.select("target_date", "ts_code", "phase2_score_mean", "phase1_hit_count", "adjusted_phase2_score")


FINAL = """select p.target_date, p.ts_code, phase1_seen_count as phase1_hit_count, best_phase1_score_mean, t.phase2_score_mean, t.phase2_score_min, t.phase2_score_mean as final_score,
  row_number() over (partition by p.target_date order by t.phase2_score_mean desc, t.phase2_score_mean desc, best_phase1_score_mean desc, p.ts_code) as final_rank, 'candidate' as decision,
  'score_col=phase2_score_mean; ranked_by=final_score,phase2_score_mean,best_phase1_score_mean; final_merge_config=default' as reason from pool p join ts2 t using (target_date, ts_code)"""
FINAL_COLS = ["target_date", "ts_code", "phase1_hit_count", "best_phase1_score_mean", "phase2_score_mean", "phase2_score_min", "final_score", "final_rank", "decision", "reason"]


def finals(spark, sf):
    anchors, h, pool = staged(spark, sf)
    pool = tk.normalized_pool(pool)
    scores = tk.review_phase2(target_scores(spark, sf, pool), pool, load_bars(spark, sf))
    return h, pool, scores, tk.final_candidates(pool, scores)


@query("final_candidates", oracle(FINAL, TSC_SQL, dates="target_date", nums="best_phase1_score_mean phase2_score_mean phase2_score_min final_score", ints="phase1_hit_count final_rank"))
def _final(spark, sf):
    return finals(spark, sf)[3].select(*FINAL_COLS)


@query(
    "two_phase_report",
    oracle(
        """select target_date, 'phase1_hits' as stage, count(*) as rows from th group by 1 union all select target_date, 'phase1_pool', count(*) from pool group by 1 union all select target_date, 'phase2_scores', count(*) from ts2 group by 1
           union all select target_date, 'final_candidates', count(*) from pool join ts2 using (target_date, ts_code) group by 1""",
        TSC_SQL, dates="target_date", ints="rows",
    ),
)
def _report(spark, sf):
    return tk.stage_report(*finals(spark, sf)).select("target_date", "stage", "rows")


@query("report_top", oracle(f"select target_date, ts_code, final_rank, final_score from ({FINAL}) where final_rank <= 5", TSC_SQL, dates="target_date", nums="final_score", ints="final_rank"))
def _top(spark, sf):
    return tk.report_top(finals(spark, sf)[3], 5).select("target_date", "ts_code", "final_rank", "final_score")


@query(
    "pending_targets",
    oracle("select date as target_date from all_dates where date not in (select anchor_date from hits where day(anchor_date) <> 7)", HITS_SQL, dates="target_date"),
)
def _pending(spark, sf):
    d = dense_dates(load_bars(spark, sf)).select(F.col("date").alias("target_date"))
    return tk.pending_targets(d, hits(spark, sf).where(F.dayofmonth("anchor_date") != 7).select(F.col("anchor_date").alias("target_date")))


def pseudo(prefix: str, a: str, b: str):
    """Scorer from two features, so that no model is needed."""
    part = lambda c: F.coalesce(F.col(c) * 100 - F.floor(F.col(c) * 100), F.lit(0.0))
    return lambda df: df.withColumns({f"{prefix}_score_lgbm": part(a), f"{prefix}_score_xgb": part(b)})


def _tracked(spark, sf):
    b = stored(load_bars(spark, sf))
    d = dense_dates(b)
    t = d.select(F.col("date").alias("target_date"))
    return tk.run_tracking(b, t, pseudo("phase1", "base_range_pct", "base_vol_cv"), pseudo("phase2", "volatility_20", "recent_return_10"), top_n=10, lookback=6, reviewer="ma120_trend_soft")


@query("tracking_run_final")
def _run_final(spark, sf):
    return _tracked(spark, sf)["final"].select("target_date", "ts_code", "phase1_hit_count", "phase2_score_mean", "adjusted_phase2_score", "final_score", "final_rank", "reason")


@query("tracking_run_paths")
def _run_paths(spark, sf):
    return _tracked(spark, sf)["tracking"].select("target_date", "ts_code", "anchor_date", "days_since_anchor", "current_return_from_anchor", "phase2_score_mean")
