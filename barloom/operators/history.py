"""Point-in-time windows of bars for samples (ts_code, asof_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import BARS
from barloom.operators.asof import asof_join


def bar_index(bars: DataFrame) -> DataFrame:
    """Bars with their 1-based position ``rn`` in the entity."""
    return bars.where("trade_date is not null").withColumn("rn", BARS.index())


def locate(samples: DataFrame, bars: DataFrame, date_col: str = "asof_date") -> DataFrame:
    """Samples with ``bar_date`` and ``pos`` (bars up to the as-of date); both NULL when every bar is later."""
    pos = bar_index(bars).select("ts_code", F.col("trade_date").alias(date_col), F.col("rn").alias("pos"))
    return asof_join(samples, pos, date_col, "ts_code", bounded=True, matched_on="bar_date")


def block_bars(bars: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """(ts_code, block, bars): the bars of a block of ``size`` positions and of the block before it, as one array.

    Every window of ``size`` bars that ends in a block lies in that array, so a window moves as part of at most ``size``
    others and is never a set of rows.
    """
    indexed = bar_index(bars)
    own = F.floor((F.col("rn") - 1) / size)
    each = indexed.select("ts_code", F.explode(F.array(own, own + 1)).alias("block"), F.struct("rn", *columns).alias("bar"))
    return each.groupBy("ts_code", "block").agg(F.sort_array(F.collect_list("bar")).alias("bars"))


def block_start(block: Column, size: int) -> Column:
    """Position of the first bar in a block's array."""
    return F.greatest(block - 1, F.lit(0)) * size + 1


def history_windows(
    samples: DataFrame, bars: DataFrame, window_size: int, min_history: int, columns: list[str] | None = None
) -> DataFrame:
    """Samples with ``window``, an array of their last ``window_size`` bars in time order; no row with too little history.

    A sample meets one array per (entity, block of bars) and cuts its window out of it.
    """
    size = int(window_size)
    cols = columns or [c for c in bars.columns if c not in ("ts_code",)]
    found = locate(samples, bars).where(F.col("pos") >= max(size, int(min_history)))
    left = found.withColumn("block", F.floor((F.col("pos") - 1) / size))
    joined = left.join(block_bars(bars, size, cols), ["ts_code", "block"])
    start = (F.col("pos") - size + 2 - block_start(F.col("block"), size)).cast("int")
    return joined.select(*samples.columns, F.slice("bars", start, F.lit(size)).alias("window"))


def history_window(
    samples: DataFrame, bars: DataFrame, window_size: int, min_history: int, columns: list[str] | None = None
) -> DataFrame:
    """The rows of ``history_windows``, one per bar, with ``offset`` from 0."""
    cols = columns or [c for c in bars.columns if c not in ("ts_code",)]
    clash = {c: f"bar_{c}" if c in samples.columns else c for c in cols}
    rows = history_windows(samples, bars, window_size, min_history, cols).select(*samples.columns, F.posexplode("window").alias("offset", "__w"))
    return rows.select(*samples.columns, F.col("offset").cast("bigint").alias("offset"), *[F.col("__w")[c].alias(n) for c, n in clash.items()])


def skip_reasons(samples: DataFrame, bars: DataFrame, window_size: int, min_history: int) -> DataFrame:
    """Why a sample yields no window: unknown symbol, as-of before the first bar, or history too short."""
    known = bars.select("ts_code").distinct().withColumn("__known", F.lit(True))
    found = locate(samples, bars).join(known, "ts_code", "left")
    reason = (
        F.when(F.col("__known").isNull(), "missing_symbol")
        .when(F.col("pos").isNull(), "asof_not_covered")
        .when(F.col("pos") < max(window_size, min_history), "insufficient_history")
        .otherwise("ok")
    )
    return found.withColumn("skip_reason", reason).drop("__known")


def sequence_matrix(windows: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """One float matrix per row of ``history_windows``: forward fill, then backward fill, then 0.

    The other bars of a window are looked at only where a value is missing.
    """

    def value(x: Column, i: Column, c: str) -> Column:
        known = lambda w: F.filter(F.transform(w, lambda y: y[c]), lambda v: v.isNotNull())
        before = F.try_element_at(known(F.slice("window", F.lit(1), i + 1)), F.lit(-1))
        after = F.try_element_at(known(F.col("window")), F.lit(1))
        return F.coalesce(x[c], before, after).cast("double")

    row = lambda x, i: F.array(*[F.coalesce(value(x, i, c), F.lit(0.0)).cast("float") for c in columns])
    return windows.select(key, F.transform("window", row).alias("sequence"))
