"""Quality reports, audits, metrics, comparisons and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.alignment import ENS_SQL
from barloom.catalog.core import oracle, query
from barloom.catalog.views import ALIGNED_SQL, DIRTY_SQL, PREDS_SQL, SAMPLES_SQL, aligned, dirty, pred, samples
from barloom.functions.cols import sample_id
from barloom.functions.ordering import exact_quantiles
from barloom.functions.windows import BARS
from barloom.operators import comparison as cmp, metrics as mt, profile as pf, quality as qa
from barloom.operators.schema import duplicate_rows
from barloom.session import stored
from barloom.sources.bars import load, load_bars


@query(
    "symbol_history",
    oracle("select symbol, count(*) as rows, min(trade_date) as first_trade_date, max(trade_date) as last_trade_date from dirty group by symbol", DIRTY_SQL,
           dates="first_trade_date last_trade_date", ints="rows"),
)
def _history(spark, sf):
    return qa.symbol_history(dirty(spark, sf))


@query(
    "shortest_histories",
    oracle("select symbol, count(*) as rows, min(trade_date) as first_trade_date, max(trade_date) as last_trade_date from dirty group by symbol order by rows, symbol limit 20", DIRTY_SQL,
           dates="first_trade_date last_trade_date", ints="rows"),
)
def _shortest(spark, sf):
    return qa.extreme_histories(qa.symbol_history(dirty(spark, sf)), 20)


RATES = " union all ".join(f"select '{c}' as column_name, avg(case when {c} is null then 1.0 else 0.0 end) as missing_rate from dirty" for c in qa.QUALITY_COLUMNS)
ANOM = {
    "high_less_than_low": "high < low", "close_non_positive": "close <= 0", "adj_close_non_positive": "adj_close <= 0", "volume_negative": "volume < 0",
    "ohlc_non_positive": "open <= 0 or high <= 0 or low <= 0 or close <= 0",
}


@query("missing_rates", oracle(RATES, DIRTY_SQL, nums="missing_rate"))
def _missing(spark, sf):
    return qa.missing_rates(dirty(spark, sf))


@query(
    "anomaly_counts",
    oracle(" union all ".join(f"select '{n}' as anomaly, count(*) filter (where {c}) as row_count from dirty" for n, c in ANOM.items()), DIRTY_SQL, ints="row_count"),
)
def _anomalies(spark, sf):
    return qa.anomaly_counts(dirty(spark, sf))


@query(
    "anomaly_examples",
    oracle(
        " union all ".join(f"select * from (select '{n}' as anomaly, symbol, trade_date, ord, high, low, close, volume from dirty where {c} order by symbol, trade_date, ord limit 20)" for n, c in ANOM.items()),
        DIRTY_SQL, dates="trade_date", nums="high low close volume", ints="ord",
    ),
)
def _examples(spark, sf):
    return qa.anomaly_examples(dirty(spark, sf)).select("anomaly", "symbol", "trade_date", F.col("ord").cast("bigint").alias("ord"), "high", "low", "close", "volume")


@query(
    "duplicate_rows",
    oracle("select symbol, trade_date, volume, ord from (select *, count(*) over (partition by symbol, trade_date) as n from dirty) where n > 1", DIRTY_SQL,
           dates="trade_date", nums="volume", ints="ord"),
)
def _dups(spark, sf):
    return duplicate_rows(dirty(spark, sf), ["symbol", "trade_date"]).select("symbol", "trade_date", "volume", F.col("ord").cast("bigint").alias("ord"))


@query(
    "late_start_symbols",
    oracle("select symbol, min(trade_date) as first_trade_date, count(*) as rows from dirty group by symbol having min(trade_date) > cast('1995-01-02' as date) + 7", DIRTY_SQL,
           dates="first_trade_date", ints="rows"),
)
def _late(spark, sf):
    return qa.late_symbols(qa.symbol_history(dirty(spark, sf)), "1995-01-02").select("symbol", "first_trade_date", "rows")


UNSORTED = "select distinct symbol from (select symbol, trade_date < lag(trade_date) over (partition by symbol order by ord) as back from dirty) where back"


@query("unsorted_symbols", oracle(UNSORTED, DIRTY_SQL))
def _unsorted(spark, sf):
    return qa.unsorted_symbols(dirty(spark, sf), "ord")


@query(
    "price_report",
    oracle(
        f"""select 'summary' as section, 'rows' as name, cast(count(*) as varchar) as value from dirty union all select 'summary', 'symbols', cast(count(distinct symbol) as varchar) from dirty
        union all select 'summary', 'date_min', cast(min(trade_date) as varchar) from dirty union all select 'summary', 'date_max', cast(max(trade_date) as varchar) from dirty
        union all select 'missing_rate', column_name, printf('%.6f', missing_rate) from ({RATES})
        union all {' union all '.join(f"select 'anomaly', '{n}', cast(count(*) filter (where {c}) as varchar) from dirty" for n, c in ANOM.items())}
        union all select 'summary', 'symbols_starting_late', cast(count(*) as varchar) from (select symbol from dirty group by symbol having min(trade_date) > cast('1995-01-09' as date))
        union all select 'summary', 'duplicate_rows', cast(count(*) as varchar) from (select count(*) over (partition by symbol, trade_date) as n from dirty) where n > 1
        union all select 'shortest', symbol, cast(rows as varchar) from (select symbol, count(*) as rows from dirty group by symbol order by rows, symbol limit 20)
        union all select 'longest', symbol, cast(rows as varchar) from (select symbol, count(*) as rows from dirty group by symbol order by rows desc, symbol limit 20)
        union all select 'warning', column_name, 'missing' from ({RATES}) where missing_rate > 0.05
        union all {' union all '.join(f"select * from (select 'warning', '{n}', 'anomaly' where (select count(*) from dirty where {c}) > 0)" for n, c in ANOM.items())}
        union all select 'summary', 'unsorted_symbols', cast(count(*) as varchar) from ({UNSORTED})""",
        DIRTY_SQL,
    ),
)
def _price_report(spark, sf):
    return qa.price_report(dirty(spark, sf), "1995-01-02", 7, "ord")


def messy_labels(spark, sf):
    """Samples with injected bad dates, repeated ids, missing and unknown labels."""
    s = samples(spark, sf)
    d = F.dayofmonth("asof_date")
    out = s.select(
        F.when(d == 3, F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id")).alias("sample_id"), "ts_code",
        F.when(d == 1, F.lit("bad")).otherwise(F.col("asof_date").cast("string")).alias("asof_date"),
        F.when(d == 5, F.lit(None)).when(d == 6, F.lit(2)).otherwise(F.col("label")).cast("int").alias("label"),
    )
    return out.unionByName(out.where(F.col("ts_code").endswith("2")))


MESSY_SQL = SAMPLES_SQL + """, messy0 as (select case when day(asof_date) = 3 then concat(sample_id, 'x') else sample_id end as sample_id, ts_code,
  case when day(asof_date) = 1 then 'bad' else cast(asof_date as varchar) end as asof_date, case when day(asof_date) = 5 then null when day(asof_date) = 6 then 2 else label end as label from samples),
messy as (select * from messy0 union all select * from messy0 where ts_code like '%2')"""


@query(
    "label_report",
    oracle(
        """select count(*) as rows, count(*) filter (where asof_date = 'bad') as invalid_dates, count(*) filter (where label is null) as null_labels, count(*) filter (where label not in (0, 1)) as invalid_labels,
           count(*) - count(distinct sample_id) as duplicate_sample_ids from messy""",
        MESSY_SQL, ints="rows invalid_dates null_labels invalid_labels duplicate_sample_ids",
    ),
)
def _label_report(spark, sf):
    return qa.label_report(messy_labels(spark, sf))


@query("daily_schema_report", oracle("select count(*) as rows, count(*) filter (where day(trade_date) = 9) as invalid_dates from bars", ints="rows invalid_dates"))
def _schema_report(spark, sf):
    b = load_bars(spark, sf)
    return qa.daily_schema_report(b.withColumn("trade_date", F.when(F.dayofmonth("trade_date") == 9, "?").otherwise(F.col("trade_date").cast("string"))))


@query(
    "daily_quality",
    oracle(
        """select symbol as ts_code, count(*) as rows, count(*) filter (where open is null or open <= 0) as bad_open, count(*) filter (where high is null or high <= 0) as bad_high, count(*) filter (where low is null or low <= 0) as bad_low,
           count(*) filter (where close is null or close <= 0) as bad_close, count(*) filter (where high < low or high < open or high < close) as high_below, count(*) filter (where low > open or low > close) as low_above,
           count(*) filter (where volume is null or volume < 0) as bad_vol, count(*) - count(distinct trade_date) as duplicate_dates from dirty group by symbol""",
        DIRTY_SQL, ints="rows bad_open bad_high bad_low bad_close high_below low_above bad_vol duplicate_dates",
    ),
)
def _quality(spark, sf):
    return qa.daily_quality(dirty(spark, sf).withColumnsRenamed({"symbol": "ts_code", "volume": "vol"}))


def moved(spark, sf):
    """Samples with unknown codes, early dates and late dates mixed in."""
    s = samples(spark, sf)
    return s.withColumns({
        "asof_date": F.when(F.col("ts_code").endswith("8"), F.lit("1990-01-01").cast("date")).when(F.col("ts_code").endswith("6"), F.lit("2009-01-01").cast("date")).otherwise(F.col("asof_date")),
        "ts_code": F.when(F.col("ts_code").endswith("4"), F.concat(F.lit("X"), "ts_code")).otherwise(F.col("ts_code")),
    })


MOVED_SQL = SAMPLES_SQL + """, moved as (select sample_id, case when ts_code like '%4' then concat('X', ts_code) else ts_code end as ts_code,
  case when ts_code like '%8' then cast('1990-01-01' as date) when ts_code like '%6' then cast('2009-01-01' as date) else asof_date end as asof_date, label from samples),
al as (select m.*, s.a as daily_start, s.b as daily_end, (select count(*) from bars b where b.ts_code = m.ts_code and b.trade_date <= m.asof_date) as n from moved m
  left join (select ts_code, min(trade_date) as a, max(trade_date) as b from bars group by ts_code) s using (ts_code))"""


@query(
    "label_alignment",
    oracle(
        """select ts_code, asof_date, issue, daily_start, daily_end, case when n > 0 then n end as history_len from (select *, case when daily_start is null then 'missing_symbol'
           when asof_date < daily_start or asof_date > daily_end then 'asof_not_covered' when n < 120 then 'insufficient_history' end as issue from al) where issue is not null""",
        MOVED_SQL, dates="asof_date daily_start daily_end", ints="history_len",
    ),
)
def _alignment(spark, sf):
    return qa.label_alignment(moved(spark, sf), load_bars(spark, sf), 120)


@query(
    "contract_audit",
    oracle(
        """select * from (
        select 'labels' as part, 'rows' as name, count(*) as value, 'info' as severity from moved union all select 'labels', 'null_ts_code', 0, 'info' union all select 'labels', 'null_asof_date', 0, 'info'
        union all select 'labels', 'null_label', 0, 'info' union all select 'labels', 'invalid_label', 0, 'info'
        union all select 'labels', 'inconsistent_sample_id', count(*), 'error' from moved where sample_id <> concat(ts_code, '_', cast(asof_date as varchar))
        union all select 'labels', 'duplicate_sample_id', 0, 'info' union all select 'labels', 'duplicate_code_date', count(*) - count(distinct concat(ts_code, cast(asof_date as varchar))), 'warning' from moved
        union all select 'daily', 'rows', count(*), 'info' from bars union all select 'daily', x, 0, 'info' from (values ('invalid_trade_date'), ('nonpositive_open'), ('nonpositive_high'), ('nonpositive_low'), ('nonpositive_close'), ('negative_vol')) t(x)
        union all select 'alignment', 'missing_symbol', count(*), 'error' from al where daily_start is null union all select 'alignment', 'asof_before_first', count(*), 'warning' from al where asof_date < daily_start
        union all select 'alignment', 'history_too_short', count(*), 'warning' from al where daily_start is not null and asof_date between daily_start and daily_end and n < 120
        union all select 'distribution', concat('label_', cast(label as varchar)), count(*), 'info' from moved group by label)""",
        MOVED_SQL, ints="value",
    ),
)
def _audit(spark, sf):
    return qa.contract_audit(moved(spark, sf), load_bars(spark, sf), 120)


def conf_sql(src: str, y: str, s: str, t: float = 0.5) -> str:
    return f"""cf as (select count(*) filter (where {y} = 1 and {s} >= {t}) as tp, count(*) filter (where {y} = 0 and {s} >= {t}) as fp, count(*) filter (where {y} = 1 and {s} < {t}) as fn, count(*) filter (where {y} = 0 and {s} < {t}) as tn from {src}),
rk as (select {y} as y, {s} as s, rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0 as ar, sum({y}) over (order by {s} desc) as ctp, count(*) over (order by {s} desc) as cn from {src}),
auc as (select (sum(case when y = 1 then ar end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc, sum(case when y = 1 then ctp * 1.0 / cn end) / sum(y) as ap from rk)"""


POINT = "(tp + tn) * 1.0 / (tp + fp + fn + tn) as accuracy, tp * 1.0 / (tp + fp) as precision, tp * 1.0 / (tp + fn) as recall, 2.0 * tp / (2 * tp + fp + fn) as f1"


@query("classification_metrics", oracle(f"select {POINT}, auc from cf, auc", f"{PREDS_SQL}, {conf_sql('pred_a', 'y_true', 'score')}", nums="accuracy precision recall f1 auc"))
def _classification(spark, sf):
    return mt.classification_metrics(pred(spark, sf, 7.13), "y_true", "score")


@query(
    "extended_metrics",
    oracle(f"select tp + fp + fn + tn as samples, (tp + fn) * 1.0 / (tp + fp + fn + tn) as positive_rate, {POINT}, auc as roc_auc, ap as pr_auc, tn, fp, fn, tp from cf, auc",
           f"{PREDS_SQL}, coarse as (select y_true, round(score, 1) as score from pred_b), {conf_sql('coarse', 'y_true', 'score')}",
           nums="positive_rate accuracy precision recall f1 roc_auc pr_auc", ints="samples tn fp fn tp"),
)
def _extended(spark, sf):
    """Scores rounded to one decimal, so almost every row is tied."""
    return mt.extended_metrics(pred(spark, sf, 3.77).withColumn("score", F.round("score", 1)), "y_true", "score")


@query(
    "regression_metrics",
    oracle("select avg(abs(score_a - score_b)) as mae, sqrt(avg((score_a - score_b) * (score_a - score_b))) as rmse, 1 - avg((score_a - score_b) * (score_a - score_b)) / var_pop(score_a) as r2 from aligned",
           ALIGNED_SQL, nums="mae rmse r2"),
)
def _regression(spark, sf):
    return mt.regression_metrics(aligned(spark, sf), "score_a", "score_b")


@query("information_coefficient", oracle("select corr(score_a, score_b) as ic from aligned", ALIGNED_SQL, nums="ic"))
def _ic(spark, sf):
    return mt.information_coefficient(aligned(spark, sf), "score_a", "score_b")


@query(
    "rank_ic",
    oracle("select corr(ra, rb) as ic from (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from (select round(score_a, 1) as a, score_b as b from aligned))",
           ALIGNED_SQL, nums="ic"),
)
def _rank_ic(spark, sf):
    return mt.information_coefficient(aligned(spark, sf).withColumn("score_a", F.round("score_a", 1)), "score_a", "score_b", True)


@query(
    "performance",
    oracle(
        """select ts_code, exp(sum(ln(1 + r))) - 1 as total_return, power(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 as annual_return, stddev_pop(r) * sqrt(252) as volatility, avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) as sharpe, min(w / peak - 1) as max_drawdown
           from (select *, max(w) over (partition by ts_code order by trade_date rows unbounded preceding) as peak from (select *, exp(sum(ln(1 + r)) over (partition by ts_code order by trade_date rows unbounded preceding)) as w
           from (select ts_code, trade_date, close / lag(close) over (partition by ts_code order by trade_date) - 1 as r from bars) where r is not null)) group by ts_code""",
        nums="total_return annual_return volatility sharpe max_drawdown",
    ),
)
def _performance(spark, sf):
    b = load_bars(spark, sf).withColumn("r", BARS.pct("close"))
    return mt.performance(b, "ts_code", "trade_date", "r")


@query(
    "performance_total_loss",
    oracle(
        """select ts_code, product(1 + r) - 1 as total_return, case when product(1 + r) >= 0 then power(product(1 + r), 252.0 / count(*)) - 1 end as annual_return, min(w / nullif(peak, 0) - 1) as max_drawdown
           from (select *, max(w) over (partition by ts_code order by trade_date rows unbounded preceding) as peak from (select *, product(1 + r) over (partition by ts_code order by trade_date rows unbounded preceding) as w
           from (select ts_code, trade_date, case when ts_code like '%3' and rn = 200 then -1.0 when ts_code like '%5' and rn % 199 = 0 then -1.5 else close / prev - 1 end::double as r
           from (select *, row_number() over w0 as rn, lag(close) over w0 as prev from bars window w0 as (partition by ts_code order by trade_date))) where r is not null)) group by ts_code""",
        nums="total_return annual_return max_drawdown",
    ),
)
def _performance_loss(spark, sf):
    b = load_bars(spark, sf).withColumns({"rn": BARS.index(), "r0": BARS.pct("close")})
    r = F.when(F.col("ts_code").endswith("3") & (F.col("rn") == 200), F.lit(-1.0)).when(F.col("ts_code").endswith("5") & (F.col("rn") % 199 == 0), F.lit(-1.5)).otherwise(F.col("r0"))
    return mt.performance(b.withColumn("r", r), "ts_code", "trade_date", "r").select("ts_code", "total_return", "annual_return", "max_drawdown")


QS = ", ".join(f"quantile_cont(score, {q}) as q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


@query(
    "score_summary",
    oracle(f"select avg(score) as mean, stddev_pop(score) as std, min(score) as min, max(score) as max, {QS} from (select score * 0.7071067811865476::double as score from pred_a)", PREDS_SQL, nums="mean std min max q25 q50 q75 q90 q95 q99"),
)
def _score_summary(spark, sf):
    return mt.score_summary(pred(spark, sf, 7.13).withColumn("score", F.col("score") * 0.7071067811865476), "score")


@query(
    "exact_quantiles_whole_table",
    oracle("select quantile_cont(x, 0.1) as q10, quantile_cont(x, 0.5) as q50, quantile_cont(x, 0.9) as q90 from (select cast(l_extendedprice as double) as x from lineitem)", bars=False, nums="q10 q50 q90"),
)
def _quantiles(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"))
    return exact_quantiles(li, "x", [0.1, 0.5, 0.9])


@query(
    "validation_profile",
    oracle(
        """select part, sample_id, score from ((select 'top' as part, sample_id, score from pred_a order by score desc, sample_id limit 15) union all (select 'bottom', sample_id, score from pred_a order by score, sample_id limit 15)
           union all (select 'false_positive', sample_id, score from pred_a where y_true = 0 and score >= 0.5 order by score desc, sample_id limit 15) union all (select 'false_negative', sample_id, score from pred_a where y_true = 1 and score < 0.5 order by score, sample_id limit 15))""",
        PREDS_SQL, nums="score",
    ),
)
def _validation(spark, sf):
    p = pred(spark, sf, 7.13)
    out = mt.extremes(p, "score", 15).unionByName(mt.validation_errors(p, "y_true", "score", 15))
    return out.select("part", "sample_id", "score")


@query(
    "class_score_means",
    oracle("select avg(case when y_true = 1 then score end) as positive_mean_score, avg(case when y_true = 0 then score end) as negative_mean_score from pred_a", PREDS_SQL, nums="positive_mean_score negative_mean_score"),
)
def _class_means(spark, sf):
    return mt.class_means(pred(spark, sf, 7.13), "y_true", "score")


@query(
    "scan_profile",
    oracle("(select 'top' as part, sample_id, score from pred_b order by score desc, sample_id limit 10) union all (select 'bottom', sample_id, score from pred_b order by score, sample_id limit 10)", PREDS_SQL, nums="score"),
)
def _scan_profile(spark, sf):
    return mt.extremes(pred(spark, sf, 3.77), "score", 10).select("part", "sample_id", "score")


TOPS_SQL = ALIGNED_SQL + """, ta as (select sample_id from aligned order by score_a desc, sample_id limit 100), tb as (select sample_id from aligned order by score_b desc, sample_id limit 100),
bk as (select 'top_a' as bucket, sample_id from ta union all select 'top_b', sample_id from tb union all select 'overlap', sample_id from ta where sample_id in (select * from tb)
  union all select 'only_a', sample_id from ta where sample_id not in (select * from tb) union all select 'only_b', sample_id from tb where sample_id not in (select * from ta))"""


@query("key_set_algebra", oracle("select bucket, sample_id from bk", TOPS_SQL))
def _sets(spark, sf):
    return cmp.buckets(cmp.top_sets(aligned(spark, sf), 100)).select("bucket", "sample_id")


@query(
    "future_return_buckets",
    oracle(
        """select b.bucket, count(f.r) as row_count, avg(f.r) as mean, quantile_cont(f.r, 0.5) as median, stddev_pop(f.r) as std from (select * from bk union all select x, null from (values ('top_a'), ('top_b'), ('overlap'), ('only_a'), ('only_b')) t(x)) b
           left join fut f on f.sample_id = b.sample_id group by b.bucket""",
        TOPS_SQL + ", fut as (select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, lead(close, 10) over (partition by ts_code order by trade_date) / close - 1 as r from bars)",
        nums="mean median std", ints="row_count",
    ),
)
def _future(spark, sf):
    fut = load_bars(spark, sf).select(sample_id("ts_code", "trade_date").alias("sample_id"), (BARS.lag("close", -10) / F.col("close") - 1).alias("future_return"))
    return cmp.future_by_bucket(cmp.top_sets(aligned(spark, sf), 100), fut)


@query(
    "model_disagreement",
    oracle(
        "(select 'a_more_bullish' as part, sample_id, score_a - score_b as delta from aligned order by round(score_a - score_b, 9) desc, sample_id limit 25) union all (select 'b_more_bullish', sample_id, score_a - score_b from aligned order by round(score_a - score_b, 9), sample_id limit 25)",
        ALIGNED_SQL, nums="delta",
    ),
)
def _disagreement(spark, sf):
    return cmp.disagreement(aligned(spark, sf), 25).select("part", "sample_id", "delta")


@query(
    "compare_models",
    oracle(
        f"""select metric, value from (
        select 'rows_aligned' as metric, count(*) * 1.0 as value from aligned union all select 'pearson', corr(score_a, score_b) from aligned
        union all select 'spearman', corr(ra, rb) from (select rank() over (order by score_a) + (count(*) over (partition by score_a) - 1) / 2.0 as ra, rank() over (order by score_b) + (count(*) over (partition by score_b) - 1) / 2.0 as rb from aligned)
        union all select 'overlap_count', count(*) from bk where bucket = 'overlap' union all select 'overlap_ratio', count(*) / 100.0 from bk where bucket = 'overlap'
        union all select 'common_errors', count(*) from er where ea and eb union all select 'only_a_errors', count(*) from er where ea and not eb union all select 'only_b_errors', count(*) from er where eb and not ea union all select 'label_mismatch', 0
        union all select 'a_' || k, v from ma unpivot (v for k in (accuracy, precision, recall, f1, auc)) union all select 'b_' || k, v from mb unpivot (v for k in (accuracy, precision, recall, f1, auc))
        union all select 'winner_' || x.k, sign(x.v - y.v) from (select * from ma unpivot (v for k in (accuracy, f1, auc))) x join (select * from mb unpivot (v for k in (accuracy, f1, auc))) y using (k)
        union all select 'a_positive_mean_score', avg(score_a) from aligned where y_true_a = 1 union all select 'a_negative_mean_score', avg(score_a) from aligned where y_true_a = 0
        union all select 'a_gap', avg(score_a) filter (where y_true_a = 1) - avg(score_a) filter (where y_true_a = 0) from aligned
        union all select 'b_positive_mean_score', avg(score_b) from aligned where y_true_a = 1 union all select 'b_negative_mean_score', avg(score_b) from aligned where y_true_a = 0
        union all select 'b_gap', avg(score_b) filter (where y_true_a = 1) - avg(score_b) filter (where y_true_a = 0) from aligned)""",
        TOPS_SQL + ", er as (select (score_a >= 0.5) <> (y_true_a = 1) as ea, (score_b >= 0.5) <> (y_true_a = 1) as eb from aligned), "
        + ", ".join(
            conf_sql("aligned", "y_true_a", f"score_{m}").replace("cf as", f"cf{m} as").replace("rk as", f"rk{m} as").replace("from rk)", f"from rk{m})").replace("auc as (", f"auc{m} as (")
            + f", m{m} as (select {POINT.replace(' as ', '::double as ').replace('(tp + tn) * 1.0 / (tp + fp + fn + tn)::double', '((tp + tn) * 1.0 / (tp + fp + fn + tn))::double')}, auc::double as auc from cf{m}, auc{m})"
            for m in ("a", "b")
        ),
        nums="value",
    ),
)
def _compare(spark, sf):
    return cmp.compare_report(stored(aligned(spark, sf)), 100)


@query(
    "temporal_split_summary",
    oracle("select split, min(asof_date) as date_min, max(asof_date) as date_max, count(*) as samples from ens group by split", ENS_SQL, dates="date_min date_max", ints="samples"),
)
def _split_summary(spark, sf):
    from barloom.catalog.alignment import ens

    return mt.temporal_split_summary(ens(spark, sf))


@query("label_split_crosstab", oracle("select label, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'valid') as valid, count(*) filter (where split = 'test') as test from ens group by label", ENS_SQL, ints="label train valid test"))
def _crosstab(spark, sf):
    from barloom.catalog.alignment import ens

    return pf.label_by_split(ens(spark, sf))


@query(
    "training_snapshot",
    oracle(
        """select count(*) as n_samples, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'valid') as n_valid, count(*) filter (where split = 'test') as n_test,
           avg(label) as positive_ratio_all, avg(label) filter (where split = 'train') as positive_ratio_train, avg(label) filter (where split = 'valid') as positive_ratio_valid, avg(label) filter (where split = 'test') as positive_ratio_test,
           min(asof_date) as date_min, max(asof_date) as date_max, count(distinct ts_code) as n_codes, 'rule' as label_source, 'time_by_asof_date' as split_method from ens""",
        ENS_SQL, dates="date_min date_max", nums="positive_ratio_all positive_ratio_train positive_ratio_valid positive_ratio_test", ints="n_samples n_train n_valid n_test n_codes",
    ),
)
def _snapshot(spark, sf):
    from barloom.catalog.alignment import ens

    return pf.training_snapshot(ens(spark, sf).withColumn("label_source", F.lit("rule")))


PROFILE_COLS = ["lgbm_score", "xgb_score", "ensemble_score", "constant"]


@query(
    "feature_profile",
    oracle(
        " union all ".join(
            f"""select '{c}' as feature, count(*) filter (where {c} is null) as missing_count, avg(case when {c} is null then 1.0 else 0.0 end) as missing_ratio, count(distinct {c}) + case when count(*) > count({c}) then 1 else 0 end <= 1 as is_constant,
                var_pop({c}) as variance, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, max({c}) as max from ep"""
            for c in PROFILE_COLS
        ),
        ENS_SQL + ", ep as (select * replace (lgbm_score * 0.7071067811865476::double as lgbm_score, case when ts_code like '%3' then null else xgb_score * 0.7071067811865476::double end as xgb_score), 1.5::double as constant from ens)",
        nums="missing_ratio variance mean std min q25 q50 q75 max", ints="missing_count",
    ),
)
def _profile(spark, sf):
    from barloom.catalog.alignment import ens

    e = ens(spark, sf).withColumns({"lgbm_score": F.col("lgbm_score") * 0.7071067811865476, "xgb_score": F.when(~F.col("ts_code").endswith("3"), F.col("xgb_score") * 0.7071067811865476), "constant": F.lit(1.5)})
    return pf.feature_profile(stored(e.select(*PROFILE_COLS)), PROFILE_COLS)


@query(
    "dataset_shape",
    oracle("select count(*) as meta_rows, count(*) as feature_rows, 0 as repeated_ids, 0 as unmatched_ids, avg(label) as positive_ratio from ens", ENS_SQL, nums="positive_ratio", ints="meta_rows feature_rows repeated_ids unmatched_ids"),
)
def _shape(spark, sf):
    from barloom.catalog.alignment import ens

    e = ens(spark, sf)
    return pf.dataset_shape(e.select("sample_id", "label"), e.select("sample_id", "lgbm_score"))
