"""Joins and rankings of model predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordering import take_first, with_global_rank
from barloom.operators.schema import require_columns

KEYS = ["sample_id", "ts_code", "asof_date"]
PASSTHROUGH = [
    "anchor_date", "pool_entry_date", "phase1_seen_count", "phase1_seen_dates", "last_seen_phase1_date",
    "best_phase1_date", "best_phase1_score_mean", "phase1_score_mean", "phase1_score_min", "phase2_score_min",
]


def by_score(score: str) -> list[Column]:
    return [F.desc_nulls_last(score), F.asc("sample_id")]


def ranked(df: DataFrame, order: list[Column], name: str, top_n: int = 0) -> DataFrame:
    """Rank rows in order, optionally keeping the first n."""
    return with_global_rank(take_first(df, order, top_n) if top_n > 0 else df, order, name)


def intersect_models(a: DataFrame, b: DataFrame, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """Samples scored by both models with both ranks, mean, lower score and rank sum."""
    left = ranked(a.select(*KEYS, "score"), order_a, "lgbm_rank").withColumnRenamed("score", "score_lgbm")
    right = ranked(b.select(*KEYS, "score"), order_b, "xgb_rank").withColumnRenamed("score", "score_xgb")
    out = left.join(right, KEYS)
    return out.withColumns(
        {
            "score_mean": (F.col("score_lgbm") + F.col("score_xgb")) / 2,
            "score_min": F.least("score_lgbm", "score_xgb"),
            "rank_sum": F.col("lgbm_rank") + F.col("xgb_rank"),
        }
    )


def intersection_order() -> list[Column]:
    return [F.desc("score_mean"), F.desc("score_min"), F.asc("rank_sum"), F.asc("sample_id")]


def ensemble(a: DataFrame, b: DataFrame, meta: list[str], threshold: float = 0.5) -> DataFrame:
    """Join two models' predictions on all meta columns (missing values match) and combine their scores."""
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in meta]
    out = a.alias("a").join(b.alias("b"), cond).select(
        *[F.col(f"a.{c}").alias(c) for c in meta],
        F.col("a.score").alias("lgbm_score"),
        F.col("a.pred_label").alias("lgbm_pred_label"),
        F.col("b.score").alias("xgb_score"),
        F.col("b.pred_label").alias("xgb_pred_label"),
    )
    mean = (F.col("lgbm_score") + F.col("xgb_score")) / 2
    return out.withColumns(
        {
            "ensemble_score": mean,
            "score_gap": F.abs(F.col("lgbm_score") - F.col("xgb_score")),
            "ensemble_pred_label": (mean >= threshold).cast("int"),
            "model_agreement": (F.col("lgbm_pred_label") == F.col("xgb_pred_label")).cast("int"),
        }
    )


def ensemble_split_summary(e: DataFrame) -> DataFrame:
    return e.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("ensemble_pred_label").alias("candidates"),
        F.avg("model_agreement").alias("agreement_rate"),
        F.avg("ensemble_score").alias("mean_score"),
    )


def latest_candidates(e: DataFrame, top_n: int, by_gap: bool = False) -> DataFrame:
    """Predicted positives of the latest date, best first."""
    latest = e.agg(F.max("asof_date").alias("asof_date"))
    now = e.join(F.broadcast(latest), "asof_date", "left_semi").where("ensemble_pred_label = 1")
    order = [F.desc("ensemble_score"), *([F.asc("score_gap")] if by_gap else []), F.asc("sample_id")]
    return take_first(now, order, top_n)


def prepare_baseline(df: DataFrame, name: str, score: str, order: list[Column], asof_date: str | None = None, top_n: int = 0) -> DataFrame:
    require_columns(df, [*KEYS, score])
    if asof_date:
        df = df.where(F.col("asof_date").cast("string") == asof_date)
    keep = [c for c in PASSTHROUGH if c in df.columns]
    out = ranked(df, order, "baseline_rank", top_n).select(*KEYS, *keep, "baseline_rank", F.col(score).alias("baseline_score"))
    return out.withColumn("baseline_name", F.lit(name))


def prepare_specialist(
    df: DataFrame, name: str, score: str, order: list[Column], pass_rank: int, asof_date: str | None = None, top_n: int = 0
) -> DataFrame:
    require_columns(df, [*KEYS, score])
    if asof_date:
        df = df.where(F.col("asof_date").cast("string") == asof_date)
    return ranked(df, order, f"{name}_rank", top_n).select(
        *KEYS, f"{name}_rank", F.col(score).alias(f"{name}_score"), (F.col(f"{name}_rank") <= pass_rank).alias(f"pass_{name}")
    )


def join_specialists(base: DataFrame, specialists: dict[str, DataFrame]) -> DataFrame:
    """Left-join specialists; a missing pass is False and a missing rank counts as 1e9 in the rank sum."""
    out = base
    for name, s in specialists.items():
        out = out.join(s, KEYS, "left").withColumn(f"pass_{name}", F.coalesce(f"pass_{name}", F.lit(False)))
    passes = [F.col(f"pass_{n}").cast("int") for n in specialists]
    ranks = [F.coalesce(F.col(f"{n}_rank"), F.lit(10**9)) for n in specialists]
    return out.withColumns(
        {"pass_count": sum(passes, F.lit(0)), "specialist_rank_sum": sum(ranks, F.lit(0)).cast("bigint")}
    )


def review_order(primary: str) -> list[Column]:
    return [
        F.desc("pass_count"), F.desc_nulls_last(primary), F.desc_nulls_last("baseline_score"), F.asc("baseline_rank"),
        F.asc("specialist_rank_sum"),
    ]


def align_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on sample_id, else on code and date; other columns get _a and _b."""
    keys = ["sample_id"] if "sample_id" in a.columns and "sample_id" in b.columns else ["ts_code", "asof_date"]
    for d in (a, b):
        require_columns(d, keys)
    left = a.withColumnsRenamed({c: f"{c}_a" for c in a.columns if c not in keys})
    right = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in keys})
    return left.join(right, keys)


def align_features(meta: DataFrame, features: DataFrame) -> DataFrame:
    """Features in the rows of meta; a sample without features is an error."""
    lost = meta.join(features, "sample_id", "left_anti").limit(1).count()
    if lost:
        raise ValueError("samples without features")
    return meta.join(features, "sample_id")
