"""Daily universe: basic table, quotes, exclusions and optional vendor tables for one or many dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import holds
from barloom.functions.cols import lenient_date
from barloom.operators.schema import first_per_key


def stock_basic(df: DataFrame) -> DataFrame:
    """Listed codes without the Beijing exchange, list date typed."""
    return df.where(~F.col("ts_code").endswith(".BJ")).withColumn("list_date", lenient_date("list_date"))


def merge_optional(base: DataFrame, other: DataFrame, suffix: str, keys=("ts_code", "trade_date")) -> DataFrame:
    """Left join; clashing columns get the suffix.  A table without columns beyond the keys changes nothing."""
    extra = [c for c in other.columns if c not in keys]
    if not extra:
        return base
    renamed = other.withColumnsRenamed({c: c + suffix for c in extra if c in base.columns})
    return base.join(renamed, list(keys), "left")


def inner_with_suffix(base: DataFrame, other: DataFrame, suffix: str, keys=("ts_code", "trade_date")) -> DataFrame:
    renamed = other.withColumnsRenamed({c: c + suffix for c in other.columns if c not in keys and c in base.columns})
    return base.join(renamed, list(keys), "inner")


def without_codes(df: DataFrame, codes: DataFrame, keys=("ts_code",)) -> DataFrame:
    """Anti join; the engine picks broadcast from the measured size of the code set."""
    return df.join(codes.select(*keys).distinct(), list(keys), "left_anti")


def trading_universe(
    basic: DataFrame,
    daily: DataFrame,
    daily_basic: DataFrame,
    special: DataFrame,
    suspended: DataFrame,
    optional: dict[str, DataFrame] | None = None,
    *,
    min_listing_days: int = 60,
    min_total_mv: float = 200_000,
    max_total_mv: float = 5_000_000,
) -> DataFrame:
    """Filter quotes by listing age, special treatment, suspension and market value, then attach optional tables.

    Exclusions that carry a trade_date apply to that date only, so many dates run in one job.
    """
    df = basic.join(daily, "ts_code", "inner")
    df = df.withColumn("listing_days", F.datediff("trade_date", "list_date"))
    df = df.where(holds(F.col("listing_days") >= min_listing_days))
    for codes in (special, suspended):
        keys = ("ts_code", "trade_date") if "trade_date" in codes.columns else ("ts_code",)
        df = without_codes(df, codes, keys)
    df = inner_with_suffix(df, daily_basic, "_daily_basic")
    df = df.where(F.col("total_mv").between(min_total_mv, max_total_mv))
    for suffix, other in (optional or {}).items():
        df = merge_optional(df, other, suffix)
    keys = ["ts_code", "trade_date"]
    return first_per_key(df, keys, [F.col(c).asc_nulls_last() for c in df.columns if c not in keys])


def merge_flat(frames: list[DataFrame]) -> DataFrame:
    """Union by name; per (ts_code, trade_date) the row of the latest frame wins."""
    from barloom.sources.bars import one_row_per_day

    tagged = [f.withColumn("__src", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return one_row_per_day(out, "__src").drop("__src")


def dense_dates(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """Distinct dates with their position; the calendar bounds the size of this table."""
    dates = df.select(F.col(date_col).alias("date")).distinct()
    return dates.withColumn("pos", F.row_number().over(W.orderBy("date")))
