"""As-of joins, history windows, filters, joins and trading calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.timeseries import roll
from barloom.catalog.views import (
    ALIGNED_SQL,
    HITS_SQL,
    PREDS_SQL,
    SAMPLES_SQL,
    UNIVERSE_SQL,
    aligned,
    hits,
    pred,
    samples,
    universe_rows,
)
from barloom.functions.windows import BARS
from barloom.operators import calendar as cal
from barloom.operators import history as hs
from barloom.operators import predictions as pr
from barloom.operators.asof import asof_join
from barloom.operators.selection import symbols_filter
from barloom.sources import universe as uv
from barloom.sources.bars import load, load_bars

EVENT_SQL = """purchases as (select event_id, user_id, ts from events where event_type = 'purchase'),
views0 as (select user_id, ts, value, event_id as view_id from events where event_type = 'view'),
views_last as (select * from (select *, row_number() over (partition by user_id, ts order by view_id desc) as k from views0) where k = 1),
views_first as (select * from (select *, row_number() over (partition by user_id, ts order by view_id) as k from views0) where k = 1)"""


def event_sides(spark, sf):
    e = load(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value", F.col("event_id").alias("view_id"))
    return left, right


@query(
    "asof_backward",
    oracle(
        "select p.event_id, p.user_id, v.value, v.view_id from purchases p asof left join views_last v on p.user_id = v.user_id and p.ts >= v.ts",
        EVENT_SQL, nums="value", ints="event_id user_id view_id", bars=False,
    ),
)
def _asof_backward(spark, sf):
    left, right = event_sides(spark, sf)
    return asof_join(left, right, "ts", "user_id", tie="view_id").select("event_id", "user_id", "value", "view_id")


@query(
    "asof_forward",
    oracle(
        "select p.event_id, p.user_id, v.value, v.view_id from purchases p asof left join views_first v on p.user_id = v.user_id and p.ts <= v.ts",
        EVENT_SQL, nums="value", ints="event_id user_id view_id", bars=False,
    ),
)
def _asof_forward(spark, sf):
    left, right = event_sides(spark, sf)
    return asof_join(left, right, "ts", "user_id", "forward", tie="view_id").select("event_id", "user_id", "value", "view_id")


@query(
    "asof_nearest",
    oracle(
        """select event_id, user_id, case when bts is null then fv when fts is null then bv
             when epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) then bv else fv end as view_id from (
           select p.event_id, p.user_id, p.ts, b.ts as bts, b.view_id as bv, f.ts as fts, f.view_id as fv
           from purchases p asof left join views_last b on p.user_id = b.user_id and p.ts >= b.ts
           asof left join views_first f on p.user_id = f.user_id and p.ts <= f.ts)""",
        EVENT_SQL, ints="event_id user_id view_id", bars=False,
    ),
)
def _asof_nearest(spark, sf):
    left, right = event_sides(spark, sf)
    return asof_join(left, right, "ts", "user_id", "nearest", tie="view_id").select("event_id", "user_id", "view_id")


@query(
    "asof_global",
    oracle(
        """select p.event_id, v.value, v.view_id from purchases p asof left join (select * from (select *, row_number() over
           (partition by ts order by view_id desc) as g from views0) where g = 1) v on p.ts >= v.ts""",
        EVENT_SQL, nums="value", ints="event_id view_id", bars=False,
    ),
)
def _asof_global(spark, sf):
    left, right = event_sides(spark, sf)
    return asof_join(left.drop("user_id"), right.drop("user_id"), "ts", tie="view_id").select("event_id", "value", "view_id")


@query(
    "nearest_not_later",
    oracle(
        """select o_orderkey, s.ts_code, b.trade_date as bar_date, b.close from s asof left join bars b on s.ts_code = b.ts_code and s.d >= b.trade_date""",
        """s as (select o_orderkey, concat('S', lpad(cast(o_orderkey % 150 as varchar), 6, '0')) as ts_code,
             cast(o_orderdate as date) as d from orders)""",
        dates="bar_date", nums="close", ints="o_orderkey",
    ),
)
def _nearest(spark, sf):
    """Order dates located on bars; one in three codes has no bars."""
    code = F.concat(F.lit("S"), F.lpad((F.col("o_orderkey") % 150).cast("string"), 6, "0"))
    s = load(spark, sf, "orders").select("o_orderkey", code.alias("ts_code"), F.col("o_orderdate").cast("date").alias("trade_date"))
    right = load_bars(spark, sf).select("ts_code", "trade_date", "close")
    return asof_join(s, right, "trade_date", "ts_code", bounded=True, matched_on="bar_date").select("o_orderkey", "ts_code", "bar_date", "close")


WINDOW_SQL = SAMPLES_SQL + """, idx as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars),
shifted as (select sample_id, ts_code, cast(asof_date + 3 as date) as asof_date, label from samples),
placed as (select s.*, (select count(*) from bars b where b.ts_code = s.ts_code and b.trade_date <= s.asof_date) as pos from shifted s),
win as (select p.sample_id, p.ts_code, p.asof_date, i.rn - p.pos + 59 as "offset", i.trade_date, i.close, i.vol, p.label from placed p
  join idx i on i.ts_code = p.ts_code and i.rn between p.pos - 59 and p.pos where p.pos >= 120)"""


def shifted(spark, sf):
    """Samples moved three days, so most as-of dates are not bar dates."""
    return samples(spark, sf).drop("close").withColumn("asof_date", F.date_add("asof_date", 3))


@query(
    "history_window",
    oracle(
        """select sample_id, ts_code, asof_date, label, count(*) as n_rows, min(trade_date) as first_date, max(trade_date) as last_date, count(distinct "offset") as offsets,
           sum(("offset" + 1) * cast(round(close * 10000) as bigint)) as placed_close from win group by sample_id, ts_code, asof_date, label""",
        WINDOW_SQL, dates="asof_date first_date last_date", ints="label n_rows offsets placed_close",
    ),
)
def _window(spark, sf):
    """One row per sample with sums over its window, so that every bar can be a sample."""
    w = hs.history_windows(shifted(spark, sf), load_bars(spark, sf), 60, 120, ["trade_date", "close"])
    dates = F.transform("window", lambda x: x["trade_date"])
    placed = lambda x, i: (i + 1) * F.round(x["close"] * 10000).cast("bigint")
    return w.select(
        "sample_id", "ts_code", "asof_date", "label", F.size("window").cast("bigint").alias("n_rows"), F.array_min(dates).alias("first_date"), F.array_max(dates).alias("last_date"),
        F.size(F.array_distinct(F.transform("window", lambda x: x["rn"]))).cast("bigint").alias("offsets"),
        F.aggregate(F.transform("window", placed), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("placed_close"),
    )


@query(
    "sequence_matrix",
    oracle(
        """select sample_id, 60 as rows, sum(cast(floor(cast(cast(close as float) as double) * 100) as bigint)) as total, cast(max(case when "offset" = 0 then cast(close as float) end) as double) as first_close,
           max(case when "offset" = 59 then vol end) as last_vol from win group by sample_id""",
        WINDOW_SQL, ints="rows total",
    ).replace("select * replace (", "select * replace (round(cast(first_close as double), 2) as first_close, round(cast(last_vol as double), 2) as last_vol, "),
)
def _sequence(spark, sf):
    w = hs.history_windows(shifted(spark, sf), load_bars(spark, sf), 60, 120, ["close", "vol"])
    m = hs.sequence_matrix(w, ["close", "vol"])
    seq = F.col("sequence")
    # whole hundredths: their sum does not depend on the order of addition
    total = F.aggregate(seq, F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x[0].cast("double") * 100))
    return m.select(
        "sample_id", F.size(seq).alias("rows"), total.alias("total"), F.round(seq[0][0].cast("double"), 2).alias("first_close"),
        F.round(seq[59][1].cast("double"), 2).alias("last_vol"),
    )


@query(
    "window_skip_reasons",
    oracle(
        """select sample_id, case when n is null then 'missing_symbol' when pos = 0 then 'asof_not_covered' when pos < 120 then 'insufficient_history' else 'ok' end as skip_reason
           from (select s.*, (select count(*) from bars b where b.ts_code = s.code and b.trade_date <= s.d) as pos, k.n from (
             select sample_id, case when ts_code like '%4' then concat('X', ts_code) else ts_code end as code,
               case when ts_code like '%8' then cast('1990-01-01' as date) else asof_date end as d from samples) s
             left join (select ts_code, count(*) as n from bars group by ts_code) k on k.ts_code = s.code)""",
        SAMPLES_SQL,
    ),
)
def _reasons(spark, sf):
    s = samples(spark, sf).drop("close").withColumns({
        "asof_date": F.when(F.col("ts_code").endswith("8"), F.lit("1990-01-01").cast("date")).otherwise(F.col("asof_date")),
        "ts_code": F.when(F.col("ts_code").endswith("4"), F.concat(F.lit("X"), "ts_code")).otherwise(F.col("ts_code")),
    })
    return hs.skip_reasons(s, load_bars(spark, sf), 60, 120).select("sample_id", "skip_reason")


UNI_SQL = UNIVERSE_SQL + """, basic as (select upper(symbol) as ts_code, name, exchange as market, cast('1995-06-01' as date) as list_date, total_mv from universe
   where symbol not like '%6'),
quotes as (select ts_code, trade_date, close, vol, round(close * vol, 4) as total_mv, trade_date as day from bars),
suspended as (select ts_code, trade_date from bars where vol > 90),
chips as (select ts_code, trade_date, close * 0.5::double as close, vol as winner from bars where day(trade_date) < 15)"""


def universe_sides(spark, sf):
    u = universe_rows(spark, sf).select(F.upper("symbol").alias("ts_code"), "name", F.col("exchange").alias("market"), F.lit("19950601").alias("list_date"))
    u = u.withColumn("ts_code", F.when(F.col("ts_code").endswith("6"), F.concat("ts_code", F.lit(".BJ"))).otherwise(F.col("ts_code")))
    b = load_bars(spark, sf)
    day = b.select("ts_code", "trade_date", "close", "vol")
    mv = b.select("ts_code", "trade_date", F.round(F.col("close") * F.col("vol"), 4).alias("total_mv"), F.col("close"))
    special = b.where("vol > 150").select("ts_code", "trade_date")
    susp = b.where("vol > 90").select("ts_code", "trade_date")
    chips = b.where(F.dayofmonth("trade_date") < 15).select("ts_code", "trade_date", (F.col("close") * 0.5).alias("close"), F.col("vol").alias("winner"))
    return uv.stock_basic(u), day, mv, special, susp, chips


@query(
    "trading_universe",
    oracle(
        """select b.ts_code, b.name, b.market, q.trade_date, q.close, q.vol, q.total_mv, q.close as close_daily_basic, c.close as close_cyq, c.winner,
           date_diff('day', b.list_date, q.trade_date) as listing_days from basic b join quotes q on b.ts_code = q.ts_code
           left join suspended s on s.ts_code = q.ts_code and s.trade_date = q.trade_date
           left join chips c on c.ts_code = q.ts_code and c.trade_date = q.trade_date
           where s.ts_code is null and date_diff('day', b.list_date, q.trade_date) >= 60 and q.total_mv between 1000 and 6000""",
        UNI_SQL, dates="trade_date", nums="close vol total_mv close_daily_basic close_cyq winner", ints="listing_days",
    ),
)
def _trading_universe(spark, sf):
    basic, day, mv, special, susp, chips = universe_sides(spark, sf)
    empty = chips.select("ts_code", "trade_date").limit(0)
    df = uv.trading_universe(basic, day, mv, special, susp, {"_cyq": chips, "_factor": empty}, min_total_mv=1000, max_total_mv=6000)
    return df.drop("list_date")


@query("exchange_suffix_filter", oracle("select ts_code, name from basic", UNI_SQL))
def _suffix(spark, sf):
    return universe_sides(spark, sf)[0].select("ts_code", "name")


@query(
    "inner_join_suffix",
    oracle("select q.ts_code, q.trade_date, q.close, q.vol, q.close as close_x, q.total_mv from quotes q join basic b using (ts_code)", UNI_SQL,
           dates="trade_date", nums="close vol close_x total_mv"),
)
def _inner(spark, sf):
    basic, day, mv, *_ = universe_sides(spark, sf)
    return uv.inner_with_suffix(day, mv, "_x").join(basic.select("ts_code"), "ts_code", "left_semi").select(
        "ts_code", "trade_date", "close", "vol", "close_x", "total_mv"
    )


@query(
    "optional_left_join",
    oracle("select q.ts_code, q.trade_date, q.close, q.vol, c.close as close_cyq, c.winner from quotes q left join chips c using (ts_code, trade_date)",
           UNI_SQL, dates="trade_date", nums="close vol close_cyq winner"),
)
def _optional(spark, sf):
    _, day, _, _, _, chips = universe_sides(spark, sf)
    return uv.merge_optional(day, chips, "_cyq")


@query(
    "anti_join_codes",
    oracle("select ts_code, trade_date, close from quotes q where not exists (select 1 from suspended s where s.ts_code = q.ts_code and s.trade_date = q.trade_date)",
           UNI_SQL, dates="trade_date", nums="close"),
)
def _anti(spark, sf):
    _, day, _, _, susp, _ = universe_sides(spark, sf)
    return uv.without_codes(day.drop("vol"), susp, ("ts_code", "trade_date"))


@query(
    "semi_join_codes",
    oracle("select ts_code, trade_date, close from bars join (select distinct ts_code from hits) using (ts_code)", HITS_SQL, dates="trade_date", nums="close"),
)
def _semi(spark, sf):
    return load_bars(spark, sf).join(hits(spark, sf).select("ts_code"), "ts_code", "left_semi").select("ts_code", "trade_date", "close")


@query("symbol_list_filter", oracle("select ts_code, trade_date, close from bars where ts_code in ('S000001', 'S000009')", dates="trade_date", nums="close"))
def _symbols(spark, sf):
    return symbols_filter(load_bars(spark, sf), " S000001, ,S000009").select("ts_code", "trade_date", "close")


@query(
    "asof_row_selection",
    oracle(
        """select ts_code, trade_date from (select ts_code, trade_date, row_number() over (partition by ts_code order by trade_date) as rn from bars)
           where rn >= 504 and (rn - 504) % 5 = 0 and trade_date between '2000-01-01' and '2001-06-30'""",
        dates="trade_date",
    ),
)
def _asof_rows(spark, sf):
    from barloom.operators.bases import ScanRows, scan_rows

    cfg = ScanRows(mode="historical", asof_stride=5, min_asof_date="2000-01-01", max_asof_date="2001-06-30")
    return scan_rows(load_bars(spark, sf), 504, cfg).select("ts_code", "trade_date")


@query(
    "asof_row_latest",
    oracle(
        """select ts_code, max(trade_date) as trade_date from bars group by ts_code having count(*) >= 504""",
        dates="trade_date",
    ),
)
def _asof_latest(spark, sf):
    from barloom.operators.bases import ScanRows, scan_rows

    return scan_rows(load_bars(spark, sf), 504, ScanRows(mode="latest")).select("ts_code", "trade_date")


@query(
    "exact_asof_date",
    oracle(
        """select ts_code, max(trade_date) as last_date from bars group by ts_code having max(trade_date) =
           (select max(m) from (select ts_code, max(trade_date) as m from bars group by ts_code) where ts_code like '%1')""",
        dates="last_date",
    ),
)
def _exact(spark, sf):
    last = load_bars(spark, sf).groupBy("ts_code").agg(F.max("trade_date").alias("last_date"))
    asof = last.where(F.col("ts_code").endswith("1")).agg(F.max("last_date").alias("last_date"))
    return last.join(F.broadcast(asof), "last_date", "left_semi").select("ts_code", "last_date")


CAL_SQL = HITS_SQL + ", targets as (select date as target_date, pos as tpos from all_dates)"


@query(
    "anchor_dates",
    oracle("select target_date, date as anchor_date from targets join all_dates on pos between tpos - 10 and tpos - 1", CAL_SQL, dates="target_date anchor_date"),
)
def _anchors(spark, sf):
    d = cal.dense_dates(load_bars(spark, sf))
    return cal.anchor_dates(d, d.select(F.col("date").alias("target_date")), 10)


@query(
    "anchor_dates_from_start",
    oracle(
        """select target_date, date as anchor_date from targets join all_dates on pos < tpos and date >=
           (select min(trade_date) from bars where trade_date >= '2000-01-05')""",
        CAL_SQL, dates="target_date anchor_date",
    ),
)
def _anchors_start(spark, sf):
    d = cal.dense_dates(load_bars(spark, sf))
    start = str(d.where("date >= date'2000-01-05'").agg(F.min("date")).first()[0])
    return cal.anchor_dates(d, d.select(F.col("date").alias("target_date")), anchor_start=start)


@query(
    "track_dates",
    oracle("select target_date as anchor_date, date as track_date from targets join all_dates on pos between tpos + 1 and tpos + 7 where date <= '2001-01-15'",
           CAL_SQL, dates="anchor_date track_date"),
)
def _track(spark, sf):
    d = cal.dense_dates(load_bars(spark, sf))
    return cal.track_dates(d, d.select(F.col("date").alias("anchor_date")), 7, "2001-01-15")


@query(
    "intersect_models",
    oracle(
        """select a.sample_id, a.ts_code, a.asof_date, a.score as score_lgbm, a.k as lgbm_rank, b.score as score_xgb, b.k as xgb_rank,
           (a.score + b.score) / 2 as score_mean, least(a.score, b.score) as score_min, a.k + b.k as rank_sum
           from (select *, row_number() over (order by score desc, sample_id) as k from pred_a) a join
           (select *, row_number() over (order by score desc, sample_id) as k from pred_b where ts_code not like '%2') b using (sample_id)""",
        PREDS_SQL, dates="asof_date", nums="score_lgbm score_xgb score_mean score_min", ints="lgbm_rank xgb_rank rank_sum",
    ),
)
def _intersect(spark, sf):
    a, b = pred(spark, sf, 7.13), pred(spark, sf, 3.77).where("ts_code not like '%2'")
    return pr.intersect_models(a, b, pr.by_score("score"), pr.by_score("score"))


ENS_SQL = PREDS_SQL + """, m as (select a.sample_id, a.ts_code, a.asof_date, a.y_true as label, case when a.asof_date <= '1998-12-31' then 'train'
  when a.asof_date <= '2000-06-30' then 'valid' else 'test' end as split, a.score as lgbm_score, case when a.score >= 0.5 then 1 else 0 end as lgbm_pred_label,
  b.score as xgb_score, case when b.score >= 0.5 then 1 else 0 end as xgb_pred_label from pred_a a join pred_b b using (sample_id)),
ens as (select *, (lgbm_score + xgb_score) / 2 as ensemble_score, abs(lgbm_score - xgb_score) as score_gap,
  case when (lgbm_score + xgb_score) / 2 >= 0.5 then 1 else 0 end as ensemble_pred_label,
  case when lgbm_pred_label = xgb_pred_label then 1 else 0 end as model_agreement from m)"""
META = ["sample_id", "ts_code", "asof_date", "label", "split"]


def ens(spark, sf, threshold=0.5):
    from barloom.operators.splits import date_boundary_split

    sides = []
    for k in (7.13, 3.77):
        p = pred(spark, sf, k).withColumnRenamed("y_true", "label")
        p = p.withColumns({"split": date_boundary_split("asof_date", "1998-12-31", "2000-06-30"), "pred_label": (F.col("score") >= 0.5).cast("int")})
        sides.append(p)
    return pr.ensemble(*sides, META, threshold)


@query(
    "ensemble_join",
    oracle("select * from ens", ENS_SQL, dates="asof_date", nums="lgbm_score xgb_score ensemble_score score_gap", ints="label"),
)
def _ens(spark, sf):
    return ens(spark, sf)


@query(
    "ensemble_split_summary",
    oracle("select split, count(*) as samples, sum(ensemble_pred_label) as candidates, avg(model_agreement) as agreement_rate, avg(ensemble_score) as mean_score from ens group by split",
           ENS_SQL, nums="agreement_rate mean_score", ints="samples candidates"),
)
def _ens_summary(spark, sf):
    return pr.ensemble_split_summary(ens(spark, sf))


@query(
    "latest_ensemble_top",
    oracle(
        """select * replace (1 as ensemble_pred_label) from ens where ensemble_score >= 0.1 and asof_date = (select max(asof_date) from ens)
           order by ensemble_score desc, score_gap, sample_id limit 20""",
        ENS_SQL, dates="asof_date", nums="lgbm_score xgb_score ensemble_score score_gap", ints="label",
    ),
)
def _ens_latest(spark, sf):
    return pr.latest_candidates(ens(spark, sf, 0.1), 20, by_gap=True)


@query(
    "baseline_preparation",
    oracle(
        "select sample_id, ts_code, asof_date, row_number() over (order by score desc, sample_id) as baseline_rank, score as baseline_score, 'base' as baseline_name from pred_a order by score desc, sample_id limit 300",
        PREDS_SQL, dates="asof_date", nums="baseline_score", ints="baseline_rank",
    ),
)
def _baseline(spark, sf):
    return pr.prepare_baseline(pred(spark, sf, 7.13), "base", "score", pr.by_score("score"), top_n=300)


SPEC_SQL = PREDS_SQL + """, b0 as (select sample_id, ts_code, asof_date, row_number() over (order by score desc, sample_id) as baseline_rank, score as baseline_score,
  'base' as baseline_name from pred_a order by score desc, sample_id limit 300),
s0 as (select sample_id, row_number() over (order by score desc, sample_id) as spec_rank, score as spec_score from pred_b order by score desc, sample_id limit 500),
review as (select b0.*, spec_rank, spec_score, coalesce(spec_rank <= 200, false) as pass_spec, case when spec_rank <= 200 then 1 else 0 end as pass_count,
  coalesce(spec_rank, 1000000000) as specialist_rank_sum from b0 left join s0 using (sample_id))"""


def reviewed(spark, sf):
    base = pr.prepare_baseline(pred(spark, sf, 7.13), "base", "score", pr.by_score("score"), top_n=300)
    spec = pr.prepare_specialist(pred(spark, sf, 3.77), "spec", "score", pr.by_score("score"), 200, top_n=500)
    return pr.join_specialists(base, {"spec": spec})


@query(
    "specialist_join",
    oracle("select * from review", SPEC_SQL, dates="asof_date", nums="baseline_score spec_score", ints="baseline_rank spec_rank pass_count specialist_rank_sum"),
)
def _specialist(spark, sf):
    return reviewed(spark, sf)


@query(
    "review_ranking",
    oracle(
        """select *, row_number() over (order by pass_count desc, baseline_score desc, baseline_rank, specialist_rank_sum) as review_rank from review""",
        SPEC_SQL, dates="asof_date", nums="baseline_score spec_score", ints="baseline_rank spec_rank pass_count specialist_rank_sum review_rank",
    ),
)
def _review_rank(spark, sf):
    return pr.ranked(reviewed(spark, sf), pr.review_order("baseline_score"), "review_rank")


@query("prediction_alignment", oracle("select * from aligned", ALIGNED_SQL, nums="score_a score_b", ints="y_true_a y_true_b"))
def _aligned(spark, sf):
    return aligned(spark, sf)


@query(
    "feature_alignment",
    oracle("select a.sample_id, a.y_true, b.score from pred_a a join pred_b b using (sample_id)", PREDS_SQL, nums="score", ints="y_true"),
)
def _feature_alignment(spark, sf):
    meta = pred(spark, sf, 7.13).select("sample_id", "y_true")
    return pr.align_features(meta, pred(spark, sf, 3.77).select("sample_id", "score"))


@query(
    "prediction_sort",
    oracle("select sample_id, score, row_number() over (order by score desc, sample_id) as k from pred_a", PREDS_SQL, nums="score", ints="k"),
)
def _sorted(spark, sf):
    return pr.ranked(pred(spark, sf, 7.13).select("sample_id", "score"), pr.by_score("score"), "k")


@query(
    "legacy_prefilter",
    oracle(
        f"""select ts_code from (select *, row_number() over (partition by ts_code order by trade_date desc) as back from p) where back <= 20
            group by ts_code having max(case when back = 1 then close end) between 5 and 120 and max(n) >= 25 and
            (bool_or(coalesce(pct >= 7, false)) or bool_or(coalesce(turn >= 95, false)) or bool_or(coalesce(vol > vma5 * 1.8, false)))""",
        f"""p as (select *, (close / lag(close) over (partition by ts_code order by trade_date) - 1) * 100 as pct, vol as turn,
            {roll('avg', 'vol', 5)} as vma5, count(*) over (partition by ts_code) as n from bars)""",
    ),
)
def _prefilter(spark, sf):
    from barloom.operators.legacy import PrefilterConfig, coarse_filter

    b = load_bars(spark, sf).withColumns({"pct_chg": BARS.pct("close") * 100, "turnover_rate": F.col("vol")})
    return coarse_filter(b, PrefilterConfig(min_turnover=95.0)).select("ts_code")
