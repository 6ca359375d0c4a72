"""Tables stored by date, with a marker for every finished date.

Rows lie in one folder per month and write, so that a long range is not a file per date; a marker names the write that finished a date and how many rows it has, so a date
without rows is finished too.  Markers are appended after the rows: what a broken job left has no marker, is not read and
is computed again.  The newest marker of a date counts, so a date can be replaced without deleting what readers hold open.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN, _MONTH = "store_run", "store_month"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class DatedStore:
    """Rows by ``date`` (a date column) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, date: str) -> None:
        self.spark, self.date = spark, date
        self.rows, self.marks = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/finished"

    def _markers(self) -> DataFrame:
        schema = f"{self.date} date, {_RUN} string, rows bigint"
        return self.spark.read.schema(schema).parquet(self.marks) if path_exists(self.spark, self.marks) else self.spark.createDataFrame([], schema)

    def finished(self) -> DataFrame:
        """One row per finished date: the date, its write and its number of rows."""
        newest = F.max(F.struct(_RUN, "rows"))
        return self._markers().groupBy(self.date).agg(newest.alias("m")).select(self.date, f"m.{_RUN}", "m.rows")

    def pending(self, dates: DataFrame) -> DataFrame:
        """The distinct dates (column ``date``) that are not finished."""
        return dates.select(self.date).distinct().join(self.finished().select(self.date), self.date, "left_anti")

    def add(self, df: DataFrame, dates: DataFrame) -> None:
        """Write ``df`` and mark ``dates`` as finished, those without rows as well.  A date of ``df`` that is not in ``dates``
        is refused.

        ``dates`` should be stored: it is read after ``df`` is written.
        """
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        out = df.withColumns({_RUN: F.lit(run), _MONTH: F.date_format(self.date, "yyyy-MM")}).repartition(_MONTH)
        out.write.mode("append").partitionBy(_MONTH, _RUN).parquet(self.rows)
        written = self._all(df.schema).where(F.col(_RUN) == run).groupBy(self.date).agg(F.count(F.lit(1)).alias("rows"))
        marks = dates.select(self.date).distinct().withColumn("__known", F.lit(1)).join(written, self.date, "full")
        known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("rows of a date that was not to be finished: "), F.col(self.date).cast("string"))).cast("bigint"))
        marks = marks.select(self.date, F.lit(run).alias(_RUN), F.coalesce(known, "rows", F.lit(0)).cast("bigint").alias("rows"))
        marks.coalesce(1).write.mode("append").parquet(self.marks)  # one row per date

    def _all(self, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField(_MONTH, T.StringType()), T.StructField(_RUN, T.StringType())])
        if not path_exists(self.spark, self.rows):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.rows)

    def read(self, schema: T.StructType, dates: DataFrame | None = None) -> DataFrame:
        """Rows of the finished dates among ``dates`` (default: all), from the newest write of each.

        The first and last wanted date become filters on the folders and on the files' rows; the rest is a join with the
        markers, one row per date.
        """
        wanted = self.finished().drop("rows")
        if dates is not None:
            wanted = wanted.join(dates.select(self.date).distinct(), self.date, "left_semi")
        span = wanted.agg(F.min(self.date), F.max(self.date), F.min(_RUN), F.max(_RUN)).first()
        rows = self._all(schema)
        if span[0] is None:
            return rows.limit(0).select(schema.fieldNames())
        months = F.col(_MONTH).between(f"{span[0]:%Y-%m}", f"{span[1]:%Y-%m}")
        rows = rows.where(months & F.col(_RUN).between(span[2], span[3]) & F.col(self.date).between(F.lit(span[0]), F.lit(span[1])))
        return rows.join(wanted, [self.date, _RUN], "left_semi").select(schema.fieldNames())
