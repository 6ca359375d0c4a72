"""Helpers shared by the corpus operators: text passes in Arrow batches, hash samples, hold-out folds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import ensure_checkpoint_dir, stored

#: Rows of a batch that are worked on at once; Spark bounds the bytes of a batch itself.
SLICE = 1000


def q(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_pass(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    fields: list[T.StructField],
    *,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` with columns computed from ``text``; one streaming pass without a shuffle.

    ``make`` runs once per task and returns a function from a list of texts (null stays None) to one array per field.
    ``keep`` names the columns that pass through untouched (default: all but ``text``).
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    names = [f"__{i}" for i in range(len(keep))]
    source = df.select(*[q(c).alias(n) for c, n in zip(keep, names)], q(text).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    out_names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = work(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=out_names)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[f.name for f in fields])


def explode_pass(
    df: DataFrame, columns: list[Column], make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType
) -> DataFrame:
    """Any number of rows per input row; ``make`` runs once per task and returns a function from batch to batches."""
    source = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from work(batch.slice(at, SLICE))

    return source.mapInArrow(run, schema)


def release_memory() -> None:
    """Give what a finished task has freed back to the system: a worker that is used again would keep it for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(q(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) with one row per id; unknown labels and null ids drop out, contradicting rows give the smaller label."""
    return labels.where(q(id_col).isNotNull() & q(label).isin(0, 1)).groupBy(q(id_col).alias("__id")).agg(F.min(q(label).cast("int")).alias("__y"))


def hash_sample(df: DataFrame, key: Column, bound: int, total: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, chosen by the hash of ``key`` alone, so that repeats give the same rows."""
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < F.lit(int(1_000_000 * bound / total)))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, stored before anyone collects them: the best rows of each task then meet in a task that keeps
    ``n`` of them, and not all on the driver."""
    return stored(df.orderBy(*order).limit(n))


@dataclass
class Written:
    """A table in the checkpoint folder that is read again and dropped when it is no longer needed."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> Written:
    """Parquet copy of ``df`` in the shared checkpoint folder; smaller than a checkpoint, and dropped by hand."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Written(spark.read.schema(df.schema).parquet(path), path)
