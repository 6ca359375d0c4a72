"""Two-phase tracking over a range of target dates, from stored stages.

Phase-1 rows lie in a store by anchor date and the stages of a target in stores by target date; a run computes the anchor
dates and targets that are not finished and reads the rest.  All unfinished dates go through each stage in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.calendar import anchor_dates
from barloom.plans import tracking as tk
from barloom.session import stored
from barloom.sources.dated import DatedStore
from barloom.sources.universe import dense_dates

STAGES = ("phase1_hits", "phase1_pool", "phase2_scores", "final_candidates")


class RangeStore:
    """Stores of a range run under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        root = root.rstrip("/")
        self.phase1 = DatedStore(spark, f"{root}/phase1", "anchor_date")
        self.stages = {s: DatedStore(spark, f"{root}/{s}", "target_date") for s in STAGES}

    @property
    def final(self) -> DatedStore:
        return self.stages["final_candidates"]


@dataclass
class RangeRun:
    """``summary``: one row per target, its status and the rows of each stage.  ``final``: candidates of all targets.
    ``anchors``: anchor dates with whether this run scored them."""

    summary: DataFrame
    final: DataFrame
    anchors: DataFrame


def fill_phase1(store: DatedStore, bars: DataFrame, dates: DataFrame, scorer: tk.Scorer, top_n: int, window: int = 150, min_history: int = 1, reviewer=None) -> tuple[DataFrame, DataFrame]:
    """Score the anchor dates (column ``anchor_date``) that are not stored; returns the wanted rows and the dates scored."""
    missing = stored(store.pending(dates))
    fresh = tk.phase1_cache(bars, missing.select(F.col("anchor_date").alias("asof_date")), scorer, top_n, window, min_history, reviewer)
    if not missing.isEmpty():
        store.add(fresh, missing)
    return store.read(fresh.schema, dates), missing


def run_range(
    bars: DataFrame, start: str, end: str, phase1: tk.Scorer, phase2: tk.Scorer, root: str, *, top_n: int, lookback: int = 5, window: int = 150, min_history: int = 1,
    phase1_reviewer=None, reviewer=None, merge: str = "default", skip_existing: bool = True,
) -> RangeRun:
    """Final candidates of every trading date from ``start`` to ``end``; finished targets are read and not computed again.

    Stage rows are stored before the final ones, whose marker finishes a target.
    """
    spark = bars.sparkSession
    dates = stored(dense_dates(bars))
    targets = stored(dates.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(F.col("date").alias("target_date")))
    if targets.isEmpty():
        raise ValueError(f"no target dates in {start}..{end}")
    store = RangeStore(spark, root)
    todo = stored(store.final.pending(targets)) if skip_existing else targets
    anchors = stored(anchor_dates(dates, todo, lookback))
    hits, scored = fill_phase1(store.phase1, bars, anchors.select("anchor_date"), phase1, top_n, window, min_history, phase1_reviewer)
    hits = stored(tk.hits_for_targets(hits, anchors))
    pool = stored(tk.normalized_pool(tk.stock_pool(hits)))
    scores = stored(tk.phase2_scores(bars, pool, phase2, reviewer, window, min_history))
    stages = dict(zip(STAGES, (hits, pool, scores, tk.final_candidates(pool, scores, merge))))
    if not todo.isEmpty():
        for name, df in stages.items():
            store.stages[name].add(df, todo)
    summary = targets.join(todo.withColumn("status", F.lit("computed")), "target_date", "left").fillna("skipped_existing", ["status"])
    for name, s in store.stages.items():
        summary = summary.join(s.finished().select("target_date", F.col("rows").alias(name)), "target_date", "left")
    used = anchors.select("anchor_date").distinct().join(scored.withColumn("scored", F.lit(True)), "anchor_date", "left").fillna(False, ["scored"])
    return RangeRun(summary, store.final.read(stages["final_candidates"].schema, targets), used)
