"""Shared inputs derived from the given tables, once for Spark and once for SQL (see FIXTURES.md part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.cols import sample_id
from barloom.functions.windows import BARS
from barloom.sources.bars import load, load_bars


def frac(column: str, k: float):
    v = F.col(column) * F.lit(k)
    return F.round(v - F.floor(v), 6)


def samples(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Every bar as a labelled sample."""
    b = load_bars(spark, sf) if bars is None else bars
    return b.select(
        sample_id("ts_code", "trade_date").alias("sample_id"),
        "ts_code",
        F.col("trade_date").alias("asof_date"),
        (F.col("close") > F.col("open")).cast("int").alias("label"),
        "close",
    )


SAMPLES_SQL = """samples as (select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, ts_code,
  trade_date as asof_date, case when close > open then 1 else 0 end as label, close from bars)"""


def pred(spark: SparkSession, sf: str, k: float) -> DataFrame:
    return samples(spark, sf).select("sample_id", "ts_code", "asof_date", F.col("label").alias("y_true"), frac("close", k).alias("score"))


def pred_sql(name: str, k: float) -> str:
    return f"""{name} as (select sample_id, ts_code, asof_date, label as y_true,
      round(close * {k}::double - floor(close * {k}::double), 6) as score from samples)"""


PREDS_SQL = f"{SAMPLES_SQL}, {pred_sql('pred_a', 7.13)}, {pred_sql('pred_b', 3.77)}"


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.operators.predictions import align_predictions

    cols = ("sample_id", "score", "y_true")
    return align_predictions(pred(spark, sf, 7.13).select(*cols), pred(spark, sf, 3.77).select(*cols))


ALIGNED_SQL = PREDS_SQL + """, aligned as (select a.sample_id, a.score as score_a, a.y_true as y_true_a,
  b.score as score_b, b.y_true as y_true_b from pred_a a join pred_b b using (sample_id))"""


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical prices with injected gaps, bad values, repeated and late rows."""
    b = load_bars(spark, sf).withColumn("rn", BARS.index())
    rn = F.col("rn")
    base = b.select(
        F.col("ts_code").alias("symbol"),
        "trade_date",
        "open",
        F.when(rn % 13 == 0, F.col("low") - 1.0).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(rn % 11 == 0, F.lit(None)).when(rn % 19 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when(rn % 17 == 0, -F.col("vol")).otherwise(F.col("vol")).alias("volume"),
        F.when(rn % 10 == 0, F.lit(None)).otherwise(F.col("close") * 0.5).alias("adj_close"),
        # symbols ending in 7 arrive with one block out of order
        (F.when(F.col("ts_code").endswith("7") & rn.between(20, 30), rn + 100).otherwise(rn) * 2).alias("ord"),
        rn.alias("rn"),
    )
    extra = base.where(rn % 23 == 0).withColumns({"volume": F.col("volume") + 1, "ord": F.col("ord") + 1})
    return base.unionByName(extra).drop("rn")


DIRTY_SQL = """numbered as (select *, row_number() over (partition by ts_code order by trade_date) as rn from bars),
dirty0 as (select ts_code as symbol, trade_date, open, case when rn % 13 = 0 then low - 1.0 else high end as high, low,
  case when rn % 11 = 0 then null when rn % 19 = 0 then -close else close end as close,
  case when rn % 17 = 0 then -vol else vol end as volume, case when rn % 10 = 0 then null else close * 0.5 end as adj_close,
  2 * case when ts_code like '%7' and rn between 20 and 30 then rn + 100 else rn end as ord, rn from numbered),
dirty as (select symbol, trade_date, open, high, low, close, volume, adj_close, ord from dirty0 union all
  select symbol, trade_date, open, high, low, close, volume + 1, adj_close, ord + 1 from dirty0 where rn % 23 = 0)"""


def increment(spark: SparkSession, sf: str) -> DataFrame:
    """The last 20 bars per symbol with a changed close, plus unseen symbols."""
    b = load_bars(spark, sf)
    recent = b.withColumn("__back", BARS.bars() - BARS.index()).where("__back < 20").drop("__back")
    changed = recent.withColumn("close", F.col("close") * 1.01)
    new = recent.where(F.col("ts_code").endswith("5")).withColumn("ts_code", F.concat(F.lit("N"), "ts_code"))
    return changed.unionByName(new)


INCREMENT_SQL = """recent as (select * exclude (back) from (select *, count(*) over (partition by ts_code)
    - row_number() over (partition by ts_code order by trade_date) as back from bars) where back < 20),
increment as (select ts_code, trade_date, open, high, low, close * 1.01::double as close, vol, amount from recent union all
  select concat('N', ts_code), trade_date, open, high, low, close, vol, amount from recent where ts_code like '%5')"""


def universe_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as instruments with nation and region."""
    s, n, r = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("symbol"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("exchange"),
        F.col("n_name").alias("sector"),
        F.col("s_acctbal").cast("double").alias("total_mv"),
    )


UNIVERSE_SQL = """universe as (select concat('s', lpad(cast(s_suppkey as varchar), 6, '0')) as symbol, s_name as name,
  r_name as exchange, n_name as sector, cast(s_acctbal as double) as total_mv
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Scored bars of every date, the ten best of each ranked."""
    from barloom.operators.selection import top_per_group

    s = load_bars(spark, sf).select(
        sample_id("ts_code", "trade_date").alias("sample_id"),
        "ts_code",
        F.col("trade_date").alias("anchor_date"),
        frac("close", 7.13).alias("phase1_score_lgbm"),
        frac("close", 3.77).alias("phase1_score_xgb"),
    )
    s = s.withColumns(
        {
            "phase1_score_mean": (F.col("phase1_score_lgbm") + F.col("phase1_score_xgb")) / 2,
            "phase1_score_min": F.least("phase1_score_lgbm", "phase1_score_xgb"),
        }
    )
    order = [F.desc("phase1_score_mean"), F.desc("phase1_score_min"), F.asc("ts_code")]
    return top_per_group(s, ["anchor_date"], order, 10, "phase1_rank")


HITS_SQL = """all_dates as (select trade_date as date, row_number() over (order by trade_date) as pos
  from (select distinct trade_date from bars)),
hit0 as (select concat(ts_code, '_', cast(trade_date as varchar)) as sample_id, ts_code, trade_date as anchor_date,
  round(close * 7.13::double - floor(close * 7.13::double), 6) as phase1_score_lgbm,
  round(close * 3.77::double - floor(close * 3.77::double), 6) as phase1_score_xgb from bars),
hit1 as (select *, (phase1_score_lgbm + phase1_score_xgb) / 2 as phase1_score_mean,
  least(phase1_score_lgbm, phase1_score_xgb) as phase1_score_min from hit0),
hits as (select * from (select *, row_number() over (partition by anchor_date order by phase1_score_mean desc,
  phase1_score_min desc, ts_code) as phase1_rank from hit1) where phase1_rank <= 10)"""
