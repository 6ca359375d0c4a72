"""Trading dates: anchors before a target and dates after an anchor, for many targets at once.

The distinct dates of a market are bounded by the calendar, so positions come from one small ordered table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.universe import dense_dates


def anchor_dates(
    dates: DataFrame, targets: DataFrame, lookback: int = 10, anchor_start: str | None = None
) -> DataFrame:
    """(target_date, anchor_date) for the trading dates strictly before each target.

    ``dates`` has (date, pos); ``targets`` has target_date.  Either the previous ``lookback`` dates or everything from
    an explicit start.
    """
    at = targets.join(dates, targets["target_date"] == dates["date"]).select("target_date", F.col("pos").alias("tpos"))
    if anchor_start is None:
        spans = at.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("tpos") - lookback, F.lit(1)), F.col("tpos"))))
        spans = spans.where("pos < tpos")
        return spans.join(dates, "pos").select("target_date", F.col("date").alias("anchor_date"))
    start = dates.where(F.col("date") == F.lit(anchor_start).cast("date")).select(F.col("pos").alias("spos"))
    spans = at.join(F.broadcast(start)).where("spos < tpos")  # one-row side
    spans = spans.withColumn("pos", F.explode(F.sequence("spos", F.col("tpos") - 1)))
    return spans.join(dates, "pos").select("target_date", F.col("date").alias("anchor_date"))


def require_dates(dates: DataFrame, wanted: list[str]) -> None:
    """Error for dates that are not trading dates."""
    have = {str(r["date"]) for r in dates.where(F.col("date").cast("string").isin(wanted)).collect()}
    missing = [d for d in wanted if d not in have]
    if missing:
        raise ValueError(f"not trading dates: {missing}")


def track_dates(dates: DataFrame, anchors: DataFrame, max_forward: int, target_date: str | None = None) -> DataFrame:
    """(anchor_date, track_date): the next dates after each anchor, not beyond the target."""
    at = anchors.join(dates, anchors["anchor_date"] == dates["date"]).select("anchor_date", F.col("pos").alias("apos"))
    spans = at.withColumn("pos", F.explode(F.sequence(F.col("apos") + 1, F.col("apos") + max_forward)))
    out = spans.join(dates, "pos").select("anchor_date", F.col("date").alias("track_date"))
    if target_date:
        out = out.where(F.col("track_date") <= F.lit(target_date).cast("date"))
    return out


__all__ = ["anchor_dates", "dense_dates", "require_dates", "track_dates"]
