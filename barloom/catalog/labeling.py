"""Label building, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.core import oracle, query
from barloom.catalog.evaluation import MOVED_SQL, moved
from barloom.catalog.timeseries import roll
from barloom.catalog.views import PREDS_SQL, SAMPLES_SQL, pred, samples
from barloom.operators import labels as lb, splits as sp
from barloom.plans.labels import build_label_set
from barloom.sources.bars import load_bars
from barloom.sources.universe import dense_dates


def positive_candidates(spark, sf):
    """The rare highest scores over all bars as candidates: lower-case codes, repeated rows, some without confidence."""
    p = pred(spark, sf, 7.13).where("score >= 0.994")
    confidence = F.when(F.col("score") > 0.998, F.lit("0.8"))
    own = F.struct("sample_id", F.col("score").cast("string").alias("candidate_score"), confidence.alias("confidence"))
    twin = F.struct(F.concat("sample_id", F.lit("b")).alias("sample_id"), F.lit("0.1").alias("candidate_score"), F.lit("0.2").alias("confidence"))
    # both rows of a bar at once: a union would go through the bars twice
    both = p.select(F.lower("ts_code").alias("ts_code"), F.col("asof_date").cast("string").alias("asof_date"), F.explode(F.array(own, twin)).alias("r"))
    return both.select("r.sample_id", "ts_code", "asof_date", "r.candidate_score", "r.confidence", F.lit("long_base_recent_breakout").alias("pattern_stage"))


POS_SQL = PREDS_SQL + """, posl as (select concat(ts_code, '_', cast(asof_date as varchar), '_long_base_breakout_pos') as sample_id, ts_code, asof_date, 1 as label, 'rule_long_base_breakout' as label_source,
  case when score > 0.998 then 0.8 else 0.7 end as confidence, 'long_base_breakout' as pattern_type, 'long_base_breakout' as source_miner, score as candidate_score, 'long_base_recent_breakout' as pattern_stage from pred_a where score >= 0.994)"""
POS_COLS = "sample_id ts_code asof_date label label_source confidence pattern_type source_miner candidate_score pattern_stage"


@query("positive_labels", oracle(f"select {', '.join(POS_COLS.split())} from posl", POS_SQL, dates="asof_date", nums="confidence candidate_score", ints="label"))
def _positive(spark, sf):
    return lb.positive_labels(positive_candidates(spark, sf)).select(*POS_COLS.split())


@query(
    "usable_bars",
    oracle("select ts_code, count(*) as n from bars group by ts_code having count(*) >= 520", ints="n"),
)
def _usable(spark, sf):
    return lb.usable_bars(load_bars(spark, sf), 520).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "downtrend_pool",
    oracle(
        """select ts_code, trade_date as asof_date from (select *, lag(m60, 20) over (partition by ts_code order by trade_date) as m60b from dp) where rn >= 253 and close < m60 and (m60 < m120 or m60 < m60b) and r120 < -0.15 and close < t60""",
        f"""dp as (select *, row_number() over (partition by ts_code order by trade_date) as rn, {roll('avg', 'close', 60)} as m60, {roll('avg', 'close', 120)} as m120, {roll('max', 'close', 60, 1)} as t60,
            close / lag(close, 120) over (partition by ts_code order by trade_date) - 1 as r120 from bars)""",
        dates="asof_date",
    ),
)
def _down(spark, sf):
    return lb.downtrend_pool(load_bars(spark, sf))


@query(
    "weak_base_pool",
    oracle(
        """select ts_code, trade_date as asof_date from wp where rn >= 505 and (hi - lo) / hi >= 0.15 and (sd / mu <= 0.12 or (h120 - l120) / mu <= 0.35) and close <= res * 0.97 and close >= lo * 1.05""",
        f"""wp as (select *, row_number() over (partition by ts_code order by trade_date) as rn, {roll('max', 'close', 252, 1)} as hi, {roll('min', 'close', 252, 1)} as lo, {roll('stddev_samp', 'close', 120)} as sd,
            {roll('avg', 'close', 120)} as mu, {roll('max', 'close', 120)} as h120, {roll('min', 'close', 120)} as l120, {roll('max', 'close', 120, 1)} as res from bars)""",
        dates="asof_date",
    ),
)
def _weak(spark, sf):
    return lb.weak_base_pool(load_bars(spark, sf))


@query(
    "positive_exclusion",
    oracle(
        "select ts_code, trade_date as asof_date from bars b where not exists (select 1 from posl p where p.ts_code = b.ts_code and abs(date_diff('day', b.trade_date, p.asof_date)) <= 60)",
        POS_SQL, dates="asof_date",
    ),
)
def _exclusion(spark, sf):
    pool = load_bars(spark, sf).select("ts_code", F.col("trade_date").alias("asof_date"))
    return lb.far_from(pool, lb.positive_labels(positive_candidates(spark, sf)), 60)


AV_SQL = MOVED_SQL + """, av as (select *, case when asof_date < '1995-06-01' then 'before_min_date' when daily_start is null then 'missing_symbol' when asof_date < daily_start or asof_date > daily_end then 'outside_symbol_range' end as drop_cause from al)"""


@query("label_availability", oracle("select sample_id, ts_code, asof_date, drop_cause from av", AV_SQL, dates="asof_date"))
def _available(spark, sf):
    return lb.availability(moved(spark, sf), load_bars(spark, sf), "1995-06-01").select("sample_id", "ts_code", "asof_date", "drop_cause")


@query("label_availability_counts", oracle("select coalesce(drop_cause, 'kept') as drop_cause, count(*) as n from av group by 1", AV_SQL, ints="n"))
def _available_counts(spark, sf):
    a = lb.availability(moved(spark, sf), load_bars(spark, sf), "1995-06-01")
    return a.groupBy(F.coalesce("drop_cause", F.lit("kept")).alias("drop_cause")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_range_validation",
    oracle(
        """select (select min(trade_date) from bars) as daily_min, (select max(trade_date) from bars) as daily_max, min(asof_date) as labels_min, max(asof_date) as labels_max,
           count(*) filter (where asof_date < (select min(trade_date) from bars) or asof_date > (select max(trade_date) from bars)) as outside_global, count(*) filter (where daily_start is null) as missing_symbol,
           count(*) filter (where asof_date < daily_start or asof_date > daily_end) as outside_symbol from al""",
        MOVED_SQL, dates="daily_min daily_max labels_min labels_max", ints="outside_global missing_symbol outside_symbol",
    ),
)
def _ranges(spark, sf):
    return lb.validate_ranges(moved(spark, sf), load_bars(spark, sf))


@query(
    "distinct_labels",
    oracle(
        """select sample_id, ts_code, asof_date, score from pred_a union all select concat(sample_id, 'b'), ts_code, asof_date, score from pred_b b
           where ts_code like '%9' and not exists (select 1 from pred_a a where a.ts_code = b.ts_code and a.asof_date = b.asof_date)""",
        PREDS_SQL, dates="asof_date", nums="score",
    ),
)
def _distinct(spark, sf):
    tag = lambda d: d.select("sample_id", "ts_code", "asof_date", "score", F.lit("p").alias("pattern_type"), F.lit("s").alias("label_source"))
    b = pred(spark, sf, 3.77).where("ts_code like '%9'").withColumn("sample_id", F.concat("sample_id", F.lit("b")))
    return lb.distinct_labels([tag(pred(spark, sf, 7.13)), tag(b)]).select("sample_id", "ts_code", "asof_date", "score")


@query(
    "label_finalize",
    oracle("select sample_id, ts_code, asof_date, case when y_true = 1 then 1 else 0 end as label, score as candidate_score from pred_a", PREDS_SQL, dates="asof_date", nums="candidate_score", ints="label"),
)
def _finalize(spark, sf):
    p = pred(spark, sf, 7.13).select("sample_id", "ts_code", "asof_date", F.when(F.col("y_true") == 1, 1).alias("label"), F.col("score").alias("candidate_score"))
    return lb.finalize(p).select("sample_id", "ts_code", "asof_date", "label", "candidate_score")


@query(
    "split_by_dates",
    oracle("select sample_id, case when asof_date <= '1998-12-31' then 'train' when asof_date <= '2000-06-30' then 'valid' else 'test' end as split from samples", SAMPLES_SQL),
)
def _split_dates(spark, sf):
    return samples(spark, sf).select("sample_id", sp.date_boundary_split("asof_date", "1998-12-31", "2000-06-30").alias("split"))


@query(
    "split_by_ratio",
    oracle(
        "select sample_id, case when k <= floor(n * 0.7) then 'train' when k <= floor(n * 0.7) + floor(n * 0.15) then 'valid' else 'test' end as split from (select sample_id, dense_rank() over (order by asof_date) as k, (select count(distinct asof_date) from samples) as n from samples)",
        SAMPLES_SQL,
    ),
)
def _split_ratio(spark, sf):
    return sp.ratio_split(samples(spark, sf)).select("sample_id", "split")


@query(
    "split_stratified",
    oracle(
        """select sample_id, label, case when k <= t then 'train' when k <= t + v then 'valid' else 'test' end as split from (
             select *, least(greatest(cast(round_even(n * 0.15::double, 0) as bigint), 1), n - t - 1) as v from (
               select *, least(greatest(cast(round_even(n * 0.7::double, 0) as bigint), 1), n - 2) as t from (
                 select *, row_number() over (partition by label order by md5(concat('42|', sample_id)), sample_id) as k, count(*) over (partition by label) as n from samples)))""",
        SAMPLES_SQL, ints="label",
    ),
)
def _split_stratified(spark, sf):
    """Every sample's split; classes have more than three samples here."""
    return sp.stratified_split(samples(spark, sf)).select("sample_id", "label", "split")


@query(
    "walk_forward_members",
    oracle(
        """select f.fold, 'train' as role, count(*) as rows, min(trade_date) as date_min, max(trade_date) as date_max from f join p on pos >= 0 and pos < f.test_start group by f.fold
           union all select f.fold, 'test', count(*), min(trade_date), max(trade_date) from f join p on pos >= f.test_start and pos < f.test_start + 200 group by f.fold""",
        """p as (select ts_code, trade_date, dense_rank() over (order by trade_date) - 1 as pos from bars), f as (select r as fold, 500 + r * 250 as test_start from range(0, 100) t(r) where 500 + r * 250 + 200 <= (select max(pos) + 1 from p))""",
        dates="date_min date_max", ints="fold rows",
    ),
)
def _folds(spark, sf):
    b = load_bars(spark, sf)
    d = dense_dates(b)
    n = d.count()
    panel = b.join(d.select(F.col("date").alias("trade_date"), (F.col("pos") - 1).alias("pos")), "trade_date")
    members = sp.fold_members(panel.select("ts_code", "trade_date", "pos"), "pos", sp.walk_forward(spark, n, 500, 200, 250), 250)
    return members.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("date_min"), F.max("trade_date").alias("date_max"))


@query(
    "rolling_folds",
    oracle(
        "select r as fold, r * 200 as train_start, 500 + r * 200 as train_end, 500 + r * 200 as test_start, 700 + r * 200 as test_end from range(0, 100) t(r) where 700 + r * 200 <= (select count(distinct trade_date) from bars)",
        ints="fold train_start train_end test_start test_end",
    ),
)
def _rolling(spark, sf):
    n = dense_dates(load_bars(spark, sf)).count()
    return sp.walk_forward(spark, n, 500, 200, expanding=False)


@query("negative_random")
def _negative_random(spark, sf):
    b = lb.usable_bars(load_bars(spark, sf))
    pos = lb.positive_labels(positive_candidates(spark, sf))
    pool = lb.far_from(lb.random_pool(b), pos, 30)
    return lb.negative_rows(lb.accept(pool, pos.select("ts_code", "asof_date").limit(0), 60, 50, 20, 42), "random_non_event")


@query("negative_pools")
def _negative_pools(spark, sf):
    """Capped, excluded and accepted rows of the two rule pools."""
    b = lb.usable_bars(load_bars(spark, sf))
    pos = lb.positive_labels(positive_candidates(spark, sf))
    none = pos.select("ts_code", "asof_date").limit(0)
    out = [
        lb.negative_rows(lb.accept(lb.far_from(lb.POOLS[s](b), pos, 30), none, 80, 50, 20, 7), s)
        for s in ("downtrend_continuation", "weak_base_non_breakout")
    ]
    return out[0].unionByName(out[1])


@query("label_set")
def _label_set(spark, sf):
    return build_label_set(
        positive_candidates(spark, sf), load_bars(spark, sf), positive_exclusion_days=30, train_end="1999-12-31", valid_end="2000-12-31"
    ).select("sample_id", "ts_code", "asof_date", "label", "label_source", "confidence", "pattern_type", "split")
