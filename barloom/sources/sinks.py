"""Writers and the readers that go with them."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.cols import holds, lenient_date
from barloom.operators.schema import require_columns
from barloom.sources.bars import by_entity
from barloom.sources.normalize import CN_COLUMNS, increment_rows

US_REQUIRED = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
US_BASE = ["ts_code", "symbol", "market", "trade_date", "open", "high", "low", "close", "vol", "volume"]
US_OPTIONAL = ["adj_close", "dividends", "stock_splits", "source"]


class MarketStore:
    """Canonical tables under one root: instruments, daily prices and corporate actions, split by market."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _save(self, df: DataFrame, table: str, market: str) -> str:
        path = f"{self.root}/processed/{market.lower()}/{table}"
        df.write.mode("overwrite").parquet(path)
        return path

    def save_instruments(self, df: DataFrame, market: str) -> str:
        return self._save(df, "instruments", market)

    def save_daily_prices(self, df: DataFrame, market: str) -> str:
        return self._save(df, "daily_prices", market)

    def save_corporate_actions(self, df: DataFrame, market: str) -> str:
        return self._save(df, "corporate_actions", market)

    def load_daily_prices(self, market: str, schema: T.StructType | None = None) -> DataFrame:
        path = f"{self.root}/processed/{market.lower()}/daily_prices"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema or T.StructType([]))
        return self.spark.read.parquet(path)


def us_by_symbol(prices: DataFrame, min_rows: int = 500) -> DataFrame:
    """Rows to export: upper-case symbols with enough rows, vol next to volume, market default US.

    Symbol counts come from a partial aggregate; the join that keeps the long histories is a semi join.
    """
    require_columns(prices, US_REQUIRED)
    df = prices.withColumns({"symbol": F.upper("symbol"), "trade_date": lenient_date("trade_date")})
    if min_rows > 0:
        long = df.groupBy("symbol").count().where(F.col("count") >= min_rows).select("symbol")
        df = df.join(long, "symbol", "left_semi")
    market = F.nullif(F.col("market"), F.lit("")) if "market" in df.columns else F.lit(None).cast("string")
    df = df.withColumns(
        {"ts_code": F.col("symbol"), "vol": F.col("volume"), "market": F.coalesce(market, F.lit("US"))}
    )
    return df.select(*US_BASE, *[c for c in US_OPTIONAL if c in df.columns])


def us_export_summary(prices: DataFrame, min_rows: int = 500) -> DataFrame:
    """Input rows and symbols, exported and skipped symbols."""
    per = prices.groupBy(F.upper("symbol").alias("symbol")).count()
    short = holds(F.col("count") < min_rows) if min_rows > 0 else F.lit(False)
    return per.agg(
        F.sum("count").alias("input_rows"),
        F.count(F.lit(1)).alias("input_symbols"),
        F.count_if(~short).alias("exported_symbols"),
        F.count_if(short).alias("skipped_symbols"),
    )


def write_by_symbol(df: DataFrame, path: str, *, overwrite: bool = False, key: str = "ts_code") -> None:
    """One folder per symbol, rows in date order; refuses an existing target unless told to overwrite.

    In a folder of the machine or a mounted one the tasks write the files: there Hadoop starts a process for every folder,
    file and checksum that it makes, and moves each folder when the job ends.  Elsewhere Spark's writer does it.
    """
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        _write_in_tasks(df, fs, fs.makeQualified(target), overwrite, key)
        return
    (
        df.repartition(key)
        .sortWithinPartitions(key, "trade_date")
        .write.mode("overwrite" if overwrite else "error")
        .partitionBy(key)
        .parquet(path)
    )


_NAME = "__folder"


def _write_in_tasks(df: DataFrame, fs, target, overwrite: bool, key: str) -> None:
    """The files are written beside the target and get there together, by one rename, when all are done."""
    if fs.exists(target) and not overwrite:
        raise AnalysisException(f"path exists already: {target}")
    jvm = df.sparkSession.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    root = beside.toUri().getPath()

    def folder(name: str | None) -> str:
        # the names that Spark gives to partitions
        text = re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name or "")
        return os.path.join(root, f"{key}={text or '__HIVE_DEFAULT_PARTITION__'}")

    def run(batches):
        name, writer, temp = None, None, None
        try:
            for batch in batches:
                names = batch.column(_NAME).to_numpy(zero_copy_only=False)
                body = batch.drop_columns([_NAME])
                edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if writer is None or names[a] != name:
                        if writer is not None:
                            writer.close()
                            os.replace(temp, os.path.join(folder(name), "part-0.parquet"))
                        name = names[a]
                        os.makedirs(folder(name), exist_ok=True)
                        # a second attempt of the task writes the same rows and puts them in the same place
                        temp = os.path.join(folder(name), f".{uuid.uuid4().hex}")
                        writer = pq.ParquetWriter(temp, body.schema)
                        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["files"])
                    writer.write_batch(body.slice(a, b - a))
            if writer is not None:
                writer.close()
                os.replace(temp, os.path.join(folder(name), "part-0.parquet"))
                temp = None
        finally:
            if temp and os.path.exists(temp):
                os.remove(temp)

    try:
        fs.mkdirs(beside)
        named = F.col(key).cast("string")
        placed = by_entity(df.withColumn(_NAME, F.when(named != "", named)), _NAME)
        placed.sortWithinPartitions(_NAME, "trade_date").select(_NAME, *[c for c in df.columns if c != key]).mapInArrow(run, "files bigint").agg(F.sum("files")).first()
        fs.create(jvm.org.apache.hadoop.fs.Path(beside, "_SUCCESS")).close()
        if overwrite:
            fs.delete(target, True)
        if not fs.rename(beside, target):
            raise OSError(f"could not move {beside} to {target}")
    finally:
        fs.delete(beside, True)


def export_cn_by_symbol(
    df: DataFrame, order, path: str, *, overwrite: bool = False, columns: list[str] = CN_COLUMNS
) -> None:
    write_by_symbol(increment_rows(df, order, columns), path, overwrite=overwrite)


def save_increment(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


FAILED_SCHEMA = "trade_date string, endpoints array<string>"


def save_failed_dates(df: DataFrame, path: str) -> None:
    df.select("trade_date", "endpoints").write.mode("overwrite").json(path)


def load_failed_dates(spark: SparkSession, path: str) -> DataFrame:
    """Failed endpoints per date; a value that is not a list reads as an empty list."""
    raw = spark.read.schema("trade_date string, endpoints string").json(path)
    parsed = F.from_json("endpoints", "array<string>")
    return raw.select("trade_date", F.coalesce(F.when(F.col("endpoints").startswith("["), parsed), F.array().cast("array<string>")).alias("endpoints"))


def write_ranked_csv(df: DataFrame, path: str, by_date: bool = True) -> None:
    """CSV sink; rows of a date go under ``asof_date=...``."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy("asof_date") if by_date else writer).csv(path)


def read_predictions(spark: SparkSession, path: str, asof_date: str | None = None, schema=None) -> DataFrame:
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return predictions_on(df, asof_date)


def predictions_on(df: DataFrame, asof_date: str | None = None) -> DataFrame:
    require_columns(df, ["sample_id", "ts_code", "asof_date"])
    return df if asof_date is None else df.where(F.col("asof_date").cast("string") == asof_date)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV in as-of order; unreadable dates become NULL."""
    df = spark.read.option("header", True).csv(path)
    date_col = "asof_date" if "asof_date" in df.columns else "trade_date"
    return df.withColumn("asof_date", lenient_date(date_col)).orderBy("asof_date")


def split_labels(df: DataFrame) -> DataFrame:
    """Labels that carry a train/valid/test split; keys must be present."""
    require_columns(df, ["sample_id", "ts_code", "asof_date", "label", "split"])
    out = df.withColumns(
        {
            "ts_code": F.upper(F.trim("ts_code")),
            "asof_date": lenient_date("asof_date"),
            "label": F.col("label").try_cast("int"),
            "split": F.lower(F.trim("split")),
        }
    )
    return out.dropna(subset=["sample_id", "ts_code", "asof_date", "label", "split"]).where(
        F.col("split").isin("train", "valid", "test")
    )


def write_training_matrix(df: DataFrame, path: str) -> None:
    """One aligned table: keys, features and, when present, the sequence column."""
    df.write.mode("overwrite").parquet(path)


def code_matrix(final: DataFrame, top_n: int, dates: list[str] | None = None, short_code: bool = False) -> DataFrame:
    """Rank by target date: one column per date, blank where a date has fewer rows.

    The rank is bounded by ``top_n`` and the columns by the number of dates, which pivot needs to know; pass ``dates``
    to skip the extra pass that finds them.
    """
    from pyspark.sql import Window as W

    code = F.substring_index("ts_code", ".", 1) if short_code else F.col("ts_code")
    rn = F.row_number().over(W.partitionBy("target_date").orderBy("final_rank"))
    ranked = final.withColumn("rank", rn).where(F.col("rank") <= top_n).withColumn("code", code)
    pivot = ranked.groupBy("rank").pivot("target_date", dates).agg(F.first("code"))
    all_ranks = final.sparkSession.range(1, top_n + 1).select(F.col("id").cast("int").alias("rank"))
    return all_ranks.join(F.broadcast(pivot), "rank", "left").na.fill("").orderBy("rank")
