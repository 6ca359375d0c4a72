"""The ``bars`` table: one row per (ts_code, trade_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.windows import BARS

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ts_code", T.StringType(), False),
        T.StructField("trade_date", T.DateType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "vol", "amount")],
    ]
)


def one_row_per_day(df: DataFrame, order: Column | str, keys=("ts_code", "trade_date"), keep: str = "last") -> DataFrame:
    """Keep the last (or first) row per key.

    An aggregate rather than a window: duplicates of a hot key collapse before the shuffle, and afterwards an entity
    has at most one row per calendar day.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"unsupported duplicate policy: {keep}")
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    pick = F.max_by if keep == "last" else F.min_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return kept.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def by_entity(df: DataFrame, key: str = "ts_code") -> DataFrame:
    """Hash by entity into the configured number of partitions.

    Window stages are bound by CPU and not by bytes, so their partition count is set rather than derived from the
    shuffle size; the windows and joins on the entity that follow reuse this exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Bars with one symbol per supplier and one bar per ship date; the price path follows the discounts.

    The daily sums are aggregated before the first shuffle, so a supplier with any number of lines contributes at most
    one row per day to the window stage.
    """
    day = lineitem.groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round(F.col("l_quantity")).cast("bigint")).alias("vol"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("amt_c"),
    )
    step = F.round(F.lit(100.0) * (F.col("disc") - 5 * F.col("n")) / F.col("n")).cast("bigint")
    code = F.concat(F.lit("S"), F.lpad(F.col("k").cast("string"), 6, "0"))
    day = by_entity(day.select(code.alias("ts_code"), "trade_date", "vol", "amt_c", step.alias("r_bp")))
    cum = F.sum("r_bp").over(BARS.upto)
    priced = day.withColumn("close", F.round(F.lit(100.0) * F.exp(cum / F.lit(10000.0)), 4))
    opened = priced.withColumn("open", F.coalesce(BARS.lag("close"), F.lit(100.0)))
    return opened.select(
        "ts_code",
        "trade_date",
        "open",
        (F.greatest("open", "close") * 1.01).alias("high"),
        (F.least("open", "close") * 0.99).alias("low"),
        "close",
        F.col("vol").cast("double").alias("vol"),
        (F.col("amt_c") / F.lit(100.0)).cast("double").alias("amount"),
    )


def load_bars(spark: SparkSession, sf_dir: str, upto: str | None = None) -> DataFrame:
    """All bars, or those up to a date: the price path looks back only, so lines after it change none of them."""
    lines = load(spark, sf_dir, "lineitem")
    return bars_from_lineitem(lines if upto is None else lines.where(F.col("l_shipdate").cast("date") <= F.lit(upto).cast("date")))


def write_bars_table(bars: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Bars bucketed and sorted by entity: later per-entity windows and joins need no shuffle."""
    (
        bars.repartition(buckets, "ts_code")
        .write.mode(mode)
        .bucketBy(buckets, "ts_code")
        .sortBy("ts_code", "trade_date")
        .saveAsTable(table)
    )


def symbol_bars(bars: DataFrame, ts_code: str) -> DataFrame:
    """One entity's bars; the predicate reaches the scan or prunes the bucket."""
    return bars.where(F.col("ts_code") == ts_code)
