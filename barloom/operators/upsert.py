"""Base plus increment, the increment winning on a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import one_row_per_day


def upsert(base: DataFrame, increment: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Union of both key sets with the fixed column order; aggregates before the shuffle, so repeats are cheap."""
    a = base.withColumn("__src", F.lit(0))
    b = increment.withColumn("__src", F.lit(1))
    out = one_row_per_day(a.unionByName(b, allowMissingColumns=True), "__src").drop("__src")
    if columns:
        out = out.select("ts_code", *[c for c in columns if c in out.columns and c != "ts_code"])
    return out


def upsert_summary(base: DataFrame, increment: DataFrame, merged: DataFrame) -> DataFrame:
    """Symbols on each side, and output symbols and rows, as one row."""
    n = lambda df, name: df.agg(F.count_distinct("ts_code").alias(name))
    out = merged.agg(F.count_distinct("ts_code").alias("output_symbols"), F.count(F.lit(1)).alias("output_rows"))
    return n(base, "base_symbols").join(n(increment, "increment_symbols")).join(out)  # one-row sides


def write_touched(merged: DataFrame, path: str) -> None:
    """Overwrite only the symbol partitions present in ``merged``."""
    (
        merged.repartition("ts_code")
        .sortWithinPartitions("ts_code", "trade_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ts_code")
        .parquet(path)
    )
