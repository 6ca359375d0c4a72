"""Stored runs: cached ranges, model bundles, rejected payloads and entities, cuts of hot groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.ingest import CHART_SQL, payloads
from barloom.catalog.modeling import GAP_SCHEMA, dataset, gap_days
from barloom.catalog.vectors import VEC_SQL
from barloom.catalog.views import SAMPLES_SQL, samples
from barloom.operators.features import WINDOW_FEATURES
from barloom.operators.selection import top_per_group
from barloom.plans import tracking as tk
from barloom.plans import training as tr
from barloom.plans.mining import run_user_miner
from barloom.plans.ranges import run_range
from barloom.session import scratch_path, stored
from barloom.sources import chart
from barloom.sources.bars import load_bars
from barloom.sources.universe import dense_dates


def features_as_scores(prefix: str, a: str, b: str):
    """Scorer that takes two features as scores; these features are ratios of single bars, so SQL has the same bits."""
    return lambda df: df.withColumns({f"{prefix}_score_lgbm": F.col(a), f"{prefix}_score_xgb": F.col(b)})


def ranged(spark, sf):
    """The first half of all dates, then all of them from the same store."""
    bars = stored(load_bars(spark, sf))
    dates = dense_dates(bars)
    n = dates.agg(F.max("pos")).first()[0]
    first, middle, last = (str(r["date"]) for r in dates.where(F.col("pos").isin(1, n // 2, n)).orderBy("pos").collect())  # three rows
    args = (features_as_scores("phase1", "recent_return_5", "breakout_distance_20"), features_as_scores("phase2", "recent_return_10", "breakout_distance_60"), scratch_path(spark, "range"))
    run_range(bars, first, middle, *args, top_n=10, lookback=5)
    return run_range(bars, first, last, *args, top_n=10, lookback=5)


RANGE_SQL = VEC_SQL + """, all_dates as (select trade_date as date, row_number() over (order by trade_date) as pos from (select distinct trade_date from bars)),
dv as (select s.ts_code, s.asof_date, v.recent_return_5 as a1, v.breakout_distance_20 as b1, v.recent_return_10 as a2, v.breakout_distance_60 as b2 from vec v join samples s using (sample_id)),
grid as (select c.ts_code, d.date from (select distinct ts_code from bars) c cross join all_dates d),
at_date as (select g.ts_code, g.date, a1, b1, (a1 + b1) / 2 as m1, least(a1, b1) as l1, a2, b2, (a2 + b2) / 2 as m2, least(a2, b2) as l2 from grid g asof join dv on dv.ts_code = g.ts_code and g.date >= dv.asof_date),
hits as (select * from (select *, row_number() over (partition by date order by m1 desc, l1 desc, ts_code) as rk from at_date) where rk <= 10),
anc as (select t.date as target_date, d.date as anchor_date from all_dates t join all_dates d on d.pos between t.pos - 5 and t.pos - 1),
th as (select a.target_date, a.anchor_date, h.ts_code, h.rk, h.m1 from hits h join anc a on a.anchor_date = h.date),
pool as (select target_date, ts_code, count(*) as phase1_hit_count, max(m1) as best_phase1_score_mean from th group by target_date, ts_code),
scored as (select p.*, v.m2 as phase2_score_mean, v.l2 as phase2_score_min from pool p join at_date v on v.ts_code = p.ts_code and v.date = p.target_date)"""


@query(
    "cached_range_final",
    oracle(
        """select *, phase2_score_mean as final_score, row_number() over (partition by target_date order by phase2_score_mean desc, best_phase1_score_mean desc, ts_code) as final_rank from scored""",
        RANGE_SQL, dates="target_date", nums="best_phase1_score_mean phase2_score_mean phase2_score_min final_score", ints="phase1_hit_count final_rank",
    ),
)
def _range_final(spark, sf):
    """Candidates of every date after a second run that computed only what the first had left."""
    return ranged(spark, sf).final.select("target_date", "ts_code", "phase1_hit_count", "best_phase1_score_mean", "phase2_score_mean", "phase2_score_min", "final_score", "final_rank")


@query(
    "cached_range_summary",
    oracle(
        """select d.date as target_date, case when d.pos <= (select max(pos) // 2 from all_dates) then 'skipped_existing' else 'computed' end as status, coalesce(h.n, 0) as phase1_hits,
           coalesce(p.n, 0) as phase1_pool, coalesce(s.n, 0) as phase2_scores, coalesce(s.n, 0) as final_candidates from all_dates d
           left join (select target_date, count(*) as n from th group by 1) h on h.target_date = d.date left join (select target_date, count(*) as n from pool group by 1) p on p.target_date = d.date
           left join (select target_date, count(*) as n from scored group by 1) s on s.target_date = d.date""",
        RANGE_SQL, dates="target_date", ints="phase1_hits phase1_pool phase2_scores final_candidates",
    ),
)
def _range_summary(spark, sf):
    return ranged(spark, sf).summary


REVIEW = {"midlong_trend": {"enabled": True, "min_factor": 0.25371, "score_col": "phase1_score_mean", "output_score_col": "adjusted_phase1_score"}}


@query(
    "phase1_top_reviewed",
    oracle(
        """select ts_code, date as anchor_date, m1 as phase1_score_mean, adj as adjusted_phase1_score, rk as phase1_rank from (
             select *, row_number() over (partition by date order by adj desc nulls last, m1 desc, l1 desc, ts_code) as rk from (
               select a.*, m1 * (0.25371 + (1.35 - 0.25371) * case when m / mb - 1 is null then 0 else 1 / (1 + exp(greatest(-60, least(60, -80 * (m / mb - 1))))) end) as adj
               from at_date a asof left join trs r on r.ts_code = a.ts_code and a.date >= r.trade_date)) where rk <= 5""",
        RANGE_SQL + """, trend as (select ts_code, trade_date, avg(close) over w60 as m60, count(*) over w60 as n60 from bars window w60 as (partition by ts_code order by trade_date rows 59 preceding)),
        trs as (select ts_code, trade_date, case when n60 = 60 then m60 end as m, lag(case when n60 = 60 then m60 end, 20) over (partition by ts_code order by trade_date) as mb from trend)""",
        dates="anchor_date", nums="phase1_score_mean adjusted_phase1_score", ints="phase1_rank",
    ),
)
def _phase1_reviewed(spark, sf):
    """Phase-1 top of every date by the reviewed score."""
    bars = stored(load_bars(spark, sf))
    dates = dense_dates(bars).select(F.col("date").alias("asof_date"))
    cache = tk.phase1_cache(bars, dates, features_as_scores("phase1", "recent_return_5", "breakout_distance_20"), 5, reviewer=REVIEW)
    return cache.select("ts_code", "anchor_date", "phase1_score_mean", "adjusted_phase1_score", "phase1_rank")


@query(
    "model_bundle_scores",
    oracle("select sample_id, true as same_logistic, true as same_trees, true as in_range from samples join ix using (ts_code) where ix.trade_date = samples.asof_date and rn >= 150 and asof_date > '2000-12-31'",
           SAMPLES_SQL + ", ix as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars)"),
)
def _bundles(spark, sf):
    """Saved and reloaded models, preparation included, against the models in memory."""
    d = dataset(spark, sf)
    store = tr.ModelStore(scratch_path(spark, "models"))
    train = d.where("split = 'train'")
    models = {"lr": tr.fit(train, WINDOW_FEATURES, "lr", impute=True, maxIter=20), "lgbm": tr.fit(train, WINDOW_FEATURES, "lgbm", impute=True, scale=False, maxIter=5)}
    for name, m in models.items():
        store.save(name, m)
    test = d.where("split = 'test'")
    both = store.score(models["lgbm"].score(models["lr"].score(test, "a"), "b"))
    same = lambda x, y: F.col(x) == F.col(y)
    return both.select("sample_id", same("a", "score_logistic_regression").alias("same_logistic"), same("b", "score_lightgbm").alias("same_trees"), (F.col("a").between(0, 1) & F.col("b").between(0, 1)).alias("in_range"))


def mixed_payloads(spark, sf):
    """Chart payloads, some of them spoilt by symbol: an error, cut-off JSON, no result, none at all."""
    p = payloads(spark, sf)
    end = F.substring("symbol", -1, 1)
    return p.withColumn(
        "payload",
        F.when(end == "1", F.lit('{"chart": {"result": null, "error": "symbol may be delisted"}}'))
        .when(end == "2", F.expr("substring(payload, 1, length(payload) - 20)"))
        .when(end == "3", F.lit('{"chart": {"result": []}}'))
        .when(end == "4", F.lit(None).cast("string"))
        .when(end == "6", F.lit('{"finance": {}}'))
        .otherwise(F.col("payload")),
    )


@query(
    "chart_rejects",
    oracle(
        """select ts_code as symbol, case right(ts_code, 1) when '1' then 'symbol may be delisted' when '2' then 'payload is not the JSON of a chart' when '3' then 'chart payload has no result' when '4' then 'payload is empty'
           else 'payload has no chart' end as reason, count(*) as payloads from (select distinct ts_code, year(trade_date) as y from paid where n > 1) where right(ts_code, 1) in ('1', '2', '3', '4', '6') group by 1, 2""",
        CHART_SQL, ints="payloads",
    ),
)
def _rejects(spark, sf):
    return chart.split_payloads(mixed_payloads(spark, sf)).rejected.groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("payloads"))


@query(
    "chart_prices_partial",
    oracle(
        """select ts_code as symbol, trade_date, close, case when back > 1 then vol end as volume, case when day(trade_date) = 15 then close * 0.01::double end as dividends
           from paid where n > 1 and right(ts_code, 1) not in ('1', '2', '3', '4', '6')""",
        CHART_SQL, dates="trade_date", nums="close volume dividends",
    ),
)
def _partial(spark, sf):
    good = chart.split_payloads(mixed_payloads(spark, sf)).good
    return chart.prices_of(good).select("symbol", "trade_date", "close", "volume", "dividends")


def fragile_gaps(ts_code: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """``gap_days`` that fails on entities whose code ends in 9."""
    if ts_code.endswith("9"):
        raise ValueError(f"cannot scan {len(pdf)} bars")
    return gap_days(ts_code, pdf)


GAP_SQL = "gaps as (select ts_code, trade_date as asof_date, open / lag(close, 2) over (partition by ts_code order by trade_date) - 1 as gap from bars)"


@query("user_miner_partial", oracle("select * from gaps where abs(gap) > 0.03 and ts_code not like '%9'", GAP_SQL, dates="asof_date", nums="gap"))
def _user_partial(spark, sf):
    return run_user_miner(load_bars(spark, sf), fragile_gaps, GAP_SCHEMA).rows


@query("user_miner_failures", oracle("select ts_code, concat('ValueError: cannot scan ', count(*), ' bars') as reason from bars where ts_code like '%9' group by ts_code"))
def _user_failures(spark, sf):
    return run_user_miner(load_bars(spark, sf), fragile_gaps, GAP_SCHEMA).failures


@query(
    "user_miner_accounts",
    oracle(
        """select count(distinct ts_code) as symbol_count, count(distinct ts_code) filter (where ts_code like '%9') as failed_symbols,
           count(*) filter (where abs(gap) > 0.03 and ts_code not like '%9') as candidates from gaps""",
        GAP_SQL, ints="symbol_count failed_symbols candidates",
    ),
)
def _user_accounts(spark, sf):
    bars = load_bars(spark, sf)
    return run_user_miner(bars, fragile_gaps, GAP_SCHEMA).accounts(bars)


@query(
    "top_of_hot_groups",
    oracle(
        "select label, sample_id, close, rank from (select *, row_number() over (partition by label order by close desc, sample_id) as rank from samples) where rank <= 5000",
        SAMPLES_SQL, nums="close", ints="label rank",
    ),
)
def _hot_top(spark, sf):
    """The 5,000 best samples of each label: more than a ranking window cuts before its shuffle."""
    return top_per_group(samples(spark, sf), ["label"], [F.desc("close"), F.asc("sample_id")], 5000, "rank").select("label", "sample_id", "close", "rank")
