"""Two-phase tracking over dates.

Anchor and target dates are columns, so every stage handles all dates in one job.  Scorers are functions that add two
score columns to a feature table; see ``plans.training.pair_scorer``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import sample_id
from barloom.operators.calendar import anchor_dates, track_dates
from barloom.operators.history import bar_index
from barloom.operators.review import TREND_COLUMNS, apply_adjustments, enabled_stages, reviewer_config, trend_of, with_trend_metrics
from barloom.operators.selection import top_per_group
from barloom.plans.datasets import features_for_dates

Scorer = Callable[[DataFrame], DataFrame]
FINAL_SORTS = {
    "default": ["final_score", "phase2_score_mean", "best_phase1_score_mean"],
    "fast_compatible": ["phase2_score_mean", "phase2_score_min"],
}


def with_pair(df: DataFrame, prefix: str) -> DataFrame:
    """Mean and lower of the two model scores."""
    a, b = F.col(f"{prefix}_score_lgbm"), F.col(f"{prefix}_score_xgb")
    return df.withColumns({f"{prefix}_score_mean": (a + b) / 2, f"{prefix}_score_min": F.least(a, b)})


def rank_phase1(scored: DataFrame, top_n: int, adjusted: str | None = None) -> DataFrame:
    """Top rows per anchor date, an adjusted score first when there is one."""
    fields = ([adjusted] if adjusted and adjusted in scored.columns else []) + ["phase1_score_mean", "phase1_score_min"]
    return top_per_group(scored, ["anchor_date"], [*[F.desc_nulls_last(f) for f in fields], F.asc("ts_code")], top_n, "phase1_rank")


def phase1_cache(
    bars: DataFrame, dates: DataFrame, scorer: Scorer, top_n: int, window: int = 150, min_history: int = 1, reviewer=None
) -> DataFrame:
    """Phase-1 top rows for every anchor date (column ``asof_date`` of ``dates``).

    Features and trend metrics are both of the last bar on or before the date, so a reviewer's trend comes along with the
    features and the rows of all entities and dates are not joined for it.
    """
    config = reviewer_config(reviewer)
    trend = [trend_of(s) for s in enabled_stages(config) if s.name == "midlong_trend"]
    priced = with_trend_metrics(bars, trend[0]) if trend else bars
    scored = with_pair(scorer(features_for_dates(priced, dates, window, min_history, carry=tuple(TREND_COLUMNS) if trend else ())), "phase1")
    if config:
        scored = apply_adjustments(scored, bars, config)
    return rank_phase1(scored.withColumn("anchor_date", F.col("asof_date")), top_n, "adjusted_phase1_score" if config else None)


def hits_for_targets(cache: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cached hits of each target's anchor dates; ``anchors`` is (target_date, anchor_date)."""
    return cache.join(anchors, "anchor_date")


def missing_anchor_dates(cache: DataFrame, anchors: DataFrame) -> DataFrame:
    return anchors.join(cache.select("anchor_date").distinct(), "anchor_date", "left_anti")


def stock_pool(hits: DataFrame, group: tuple[str, ...] = ("target_date", "ts_code")) -> DataFrame:
    """One row per stock: first hit, hit count, all hit dates, last hit, best hit.

    A stock has at most one hit per anchor date, so the date list is bounded by the anchor window.
    """
    keys = [g for g in group if g in hits.columns]
    order = F.struct("anchor_date", "phase1_rank")
    row = F.struct("anchor_date", "phase1_rank", "phase1_score_lgbm", "phase1_score_xgb", "phase1_score_mean", "phase1_score_min")
    best = F.struct((-F.col("phase1_score_mean")).alias("a"), (-F.col("phase1_score_min")).alias("b"), order.alias("c"))
    g = hits.groupBy(*keys).agg(
        F.min_by(row, order).alias("f"),
        F.max_by(row, order).alias("l"),
        F.min_by(row, best).alias("b"),
        F.count(F.lit(1)).alias("phase1_seen_count"),
        F.sort_array(F.collect_list("anchor_date")).alias("dates"),
    )
    c = F.col
    return g.select(
        *keys,
        c("f.anchor_date").alias("pool_entry_date"),
        *[c(f"f.{n}").alias(n) for n in ("phase1_rank", "phase1_score_lgbm", "phase1_score_xgb", "phase1_score_mean", "phase1_score_min")],
        "phase1_seen_count",
        F.array_join(F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd")), ";").alias("phase1_seen_dates"),
        c("l.anchor_date").alias("last_seen_phase1_date"),
        c("l.phase1_rank").alias("latest_phase1_rank"),
        c("l.phase1_score_lgbm").alias("latest_phase1_score_lgbm"),
        c("l.phase1_score_xgb").alias("latest_phase1_score_xgb"),
        c("l.phase1_score_mean").alias("latest_phase1_score_mean"),
        c("l.phase1_score_min").alias("latest_phase1_score_min"),
        c("b.anchor_date").alias("best_phase1_date"),
        c("b.phase1_rank").alias("best_phase1_rank"),
        c("b.phase1_score_mean").alias("best_phase1_score_mean"),
        F.lit("first_entry_per_stock").alias("pool_policy"),
    )


def normalized_pool(pool: DataFrame) -> DataFrame:
    """Pool under its stage-table names."""
    return pool.withColumns(
        {
            "first_phase1_date": F.col("pool_entry_date"),
            "last_phase1_date": F.col("last_seen_phase1_date"),
            "phase1_hit_count": F.col("phase1_seen_count"),
            "pool_status": F.lit("in_pool"),
            "name": F.col("name") if "name" in pool.columns else F.lit(""),
        }
    )


CONTEXT = ["first_phase1_date", "last_phase1_date", "best_phase1_date", "phase1_hit_count", "best_phase1_score_mean"]


def phase2_scores(bars: DataFrame, pool: DataFrame, scorer: Scorer, reviewer=None, window: int = 150, min_history: int = 1) -> DataFrame:
    """Score the pool's stocks on their target date and review the scores."""
    keys = pool.select(F.col("target_date").alias("asof_date"), "ts_code")
    feats = features_for_dates(bars, keys.select("asof_date").distinct(), window, min_history, codes=keys)
    return review_phase2(with_pair(scorer(feats), "phase2").withColumn("target_date", F.col("asof_date")), pool, bars, reviewer)


def review_phase2(scores: DataFrame, pool: DataFrame, bars: DataFrame, reviewer=None) -> DataFrame:
    config = reviewer_config(reviewer)
    out = scores.withColumn("reviewer_config", F.lit(reviewer if isinstance(reviewer, str) else ("custom" if config else "")))
    if config:
        context = pool.select("target_date", "ts_code", *[c for c in CONTEXT if c in pool.columns])
        out = apply_adjustments(out.join(context, ["target_date", "ts_code"], "left"), bars, config)
    if "adjusted_phase2_score" not in out.columns:
        out = out.withColumn("adjusted_phase2_score", F.lit(None).cast("double"))
    return out


def phase2_order() -> list[Column]:
    """Adjusted score (or the mean where nothing was adjusted), then mean and lower score."""
    return [F.desc_nulls_last(F.coalesce("adjusted_phase2_score", "phase2_score_mean")), F.desc("phase2_score_mean"), F.desc("phase2_score_min"), F.asc("ts_code")]


def final_candidates(pool: DataFrame, scores: DataFrame, merge: str = "default", sort_fields: list[str] | None = None) -> DataFrame:
    """Join pool and scores per target date and rank.

    The adjusted score counts unless a whole target date has none.  A pool is a top-n selection per anchor date, which
    bounds the rows of a target date.
    """
    clash = [c for c in scores.columns if c in pool.columns and c not in ("target_date", "ts_code")]
    out = pool.join(scores.withColumnsRenamed({c: f"{c}_phase2" for c in clash}), ["target_date", "ts_code"])
    day = W.partitionBy("target_date")
    has = F.count("adjusted_phase2_score").over(day) > 0
    out = out.withColumns(
        {
            "final_score": F.when(has, F.col("adjusted_phase2_score")).otherwise(F.col("phase2_score_mean")),
            "__col": F.when(has, F.lit("adjusted_phase2_score")).otherwise(F.lit("phase2_score_mean")),
        }
    )
    wanted = sort_fields or FINAL_SORTS.get(merge, FINAL_SORTS["default"])
    used = [f for f in wanted if f in out.columns] or ["final_score"]
    rank = F.row_number().over(day.orderBy(*[F.desc_nulls_last(f) for f in used], F.asc("ts_code")))
    reason = F.concat(F.lit("score_col="), F.col("__col"), F.lit(f"; ranked_by={','.join(used)}; final_merge_config={merge}"))
    return out.withColumns({"final_rank": rank, "decision": F.lit("candidate"), "reason": reason}).drop("__col")


def stage_report(hits: DataFrame, pool: DataFrame, scores: DataFrame, final: DataFrame) -> DataFrame:
    """Rows per stage and target date."""
    n = lambda df, stage: df.groupBy("target_date").agg(F.count(F.lit(1)).alias("rows")).withColumn("stage", F.lit(stage))
    parts = [n(hits, "phase1_hits"), n(pool, "phase1_pool"), n(scores, "phase2_scores"), n(final, "final_candidates")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_top(final: DataFrame, n: int = 30) -> DataFrame:
    return final.where(F.col("final_rank") <= n)


def price_paths(pool: DataFrame, bars: DataFrame, score_dates: DataFrame | None = None) -> DataFrame:
    """Pool rows with the price path since their anchor at each score date.

    ``score_dates`` is (anchor_date, track_date); without it the target date is scored.  A pool row meets the bars of
    its own span by position, and the running high and low are windows over that span.
    """
    if score_dates is None:
        spans = pool.withColumn("__z", F.col("target_date"))
    else:
        last = score_dates.groupBy("anchor_date").agg(F.max("track_date").alias("__z"))
        spans = pool.join(last, pool["pool_entry_date"] == last["anchor_date"]).drop("anchor_date")
    idx = bar_index(bars)
    at = idx.select("ts_code", F.col("trade_date").alias("pool_entry_date"), F.col("rn").alias("__a"), F.col("close").alias("anchor_close"))
    spans = spans.join(at, ["ts_code", "pool_entry_date"])  # no bar on the anchor date: no row
    block = 64
    blocks = F.explode(F.sequence(F.floor((F.col("__a") - 1) / block), F.floor((F.col("__a") + F.datediff("__z", "pool_entry_date") - 1) / block)))
    right = idx.select("ts_code", F.floor((F.col("rn") - 1) / block).alias("__b"), "rn", F.col("trade_date").alias("asof_date"), "high", "low", F.col("close").alias("current_close"))
    j = spans.withColumn("__b", blocks).join(right, ["ts_code", "__b"]).where((F.col("rn") >= F.col("__a")) & (F.col("asof_date") <= F.col("__z")))
    key = [c for c in ("target_date", "ts_code", "pool_entry_date") if c in j.columns]
    run = W.partitionBy(*key).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumns({"__hi": F.max("high").over(run), "__lo": F.min("low").over(run)})
    if score_dates is None:
        j = j.where("asof_date = target_date")
    else:
        want = score_dates.select(F.col("anchor_date").alias("pool_entry_date"), F.col("track_date").alias("asof_date")).distinct()
        j = j.join(want, ["pool_entry_date", "asof_date"], "left_semi")
    a = F.col("anchor_close")
    ok = lambda e: F.when(a > 0, e)
    return j.withColumns(
        {
            "event_id": sample_id("ts_code", "pool_entry_date"),
            "sample_id": sample_id("ts_code", "asof_date"),
            "anchor_date": F.col("pool_entry_date"),
            "days_since_anchor": F.col("rn") - F.col("__a"),
            "current_return_from_anchor": ok(F.col("current_close") / a - 1),
            "max_runup_since_anchor": ok(F.col("__hi") / a - 1),
            "drawdown_from_post_anchor_high": F.when(F.col("__hi") > 0, ok(F.col("current_close") / F.col("__hi") - 1)),
            "min_low_return_from_anchor": ok(F.col("__lo") / a - 1),
        }
    ).drop("__a", "__z", "__b", "__hi", "__lo", "rn", "high", "low")


def pool_score_rows(pool: DataFrame, bars: DataFrame, scores: DataFrame, score_dates: DataFrame | None = None) -> DataFrame:
    """Price paths with the phase-2 scores of the same stock and date (missing scores stay NULL)."""
    s = scores.select("ts_code", "asof_date", "phase2_score_lgbm", "phase2_score_xgb", "phase2_score_mean", "phase2_score_min").distinct()
    return price_paths(pool, bars, score_dates).join(s, ["ts_code", "asof_date"], "left")


def run_tracking(
    bars: DataFrame, targets: DataFrame, phase1: Scorer, phase2: Scorer, *, top_n: int, lookback: int = 10, window: int = 150,
    min_history: int = 1, reviewer=None, merge: str = "default",
) -> dict[str, DataFrame]:
    """All stages for all target dates: hits, pool, scores, final, report and tracked price paths."""
    from barloom.sources.universe import dense_dates

    anchors = anchor_dates(dense_dates(bars), targets, lookback)
    cache = phase1_cache(bars, anchors.select(F.col("anchor_date").alias("asof_date")).distinct(), phase1, top_n, window, min_history)
    hits = hits_for_targets(cache, anchors)
    pool = normalized_pool(stock_pool(hits))
    scores = phase2_scores(bars, pool, phase2, reviewer, window, min_history)
    final = final_candidates(pool, scores, merge)
    return {
        "hits": hits, "pool": pool, "scores": scores, "final": final, "report": stage_report(hits, pool, scores, final),
        "tracking": pool_score_rows(pool, bars, scores),
    }


def pending_targets(targets: DataFrame, done: DataFrame | None) -> DataFrame:
    """Targets without finished output."""
    return targets if done is None else targets.join(done.select("target_date").distinct(), "target_date", "left_anti")


__all__ = ["run_tracking", "track_dates"]
