"""Label set build: positives, three kinds of negatives, checks and split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from barloom.operators import labels as lb
from barloom.operators.splits import date_boundary_split
from barloom.session import ensure_checkpoint_dir


def _negatives(bars, positives, taken, source, target, seed, exclusion, max_per_symbol, min_gap, min_asof_date) -> DataFrame:
    pool = lb.POOLS[source](bars)
    if min_asof_date:
        pool = pool.where(f"asof_date >= date'{min_asof_date}'")
    free = lb.far_from(pool, positives, exclusion)
    return lb.accept(free, taken, target, max_per_symbol, min_gap, seed)


def build_label_set(
    candidates: DataFrame,
    bars: DataFrame,
    *,
    negative_ratio: float = 3.0,
    positive_exclusion_days: int = 60,
    max_negative_per_symbol: int = 50,
    min_negative_gap: int = 20,
    train_end: str = "2022-12-31",
    valid_end: str = "2024-12-31",
    min_asof_date: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Positives plus ``negative_ratio`` negatives per positive from three sources, with a time split.

    Each source sees the dates accepted by the sources before it; a shortfall is filled by a second round.  Accepted
    rows are checkpointed because the next source and the final table both read them.
    """
    ensure_checkpoint_dir(bars.sparkSession)
    b = lb.usable_bars(bars).select("ts_code", "trade_date", "close").checkpoint()
    positives = lb.available(lb.positive_labels(candidates), b, min_asof_date).checkpoint()
    count = positives.count()
    if count == 0:
        raise ValueError("no positive labels left")
    wanted = int(round(count * negative_ratio))
    parts: list[tuple[str, DataFrame]] = []
    have = 0
    empty = positives.select("ts_code", "asof_date").limit(0)

    def taken() -> DataFrame:
        return reduce(DataFrame.unionByName, [p for _, p in parts], empty)

    def draw(source: str, target: int, round_seed: int) -> int:
        part = _negatives(
            b, positives, taken(), source, target, round_seed, positive_exclusion_days, max_negative_per_symbol, min_negative_gap, min_asof_date
        ).checkpoint()
        parts.append((source, part))
        return part.count()

    for i, (source, target) in enumerate(lb.split_targets(wanted).items()):
        if target > 0:
            have += draw(source, target, seed + 10 * i)
    for i, source in enumerate(lb.NEGATIVE_SOURCES):
        if have >= wanted:
            break
        have += draw(source, wanted - have, seed + 100 + 10 * i)
    labels = lb.distinct_labels([positives.drop("split"), *[lb.negative_rows(p, s) for s, p in parts]])
    labels = lb.available(labels, b, min_asof_date)
    return lb.finalize(labels.withColumn("split", date_boundary_split("asof_date", train_end, valid_end)))
