"""Train, valid and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import col, holds
from barloom.functions.ordering import with_global_rank
from barloom.operators.selection import hash_order


def date_boundary_split(date: Column | str, train_end: str, valid_end: str) -> Column:
    """Up to train_end, up to valid_end, else test; a missing date is test."""
    d = col(date)
    before = lambda end: holds(d <= F.lit(end).cast("date"))
    return F.when(before(train_end), "train").when(before(valid_end), "valid").otherwise("test")


def ratio_split(df: DataFrame, date: str = "asof_date", train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Split by distinct date in order; all dates are train when there are fewer than three.

    The date table is bounded by the calendar.
    """
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    k = F.row_number().over(W.orderBy(date))
    n = F.count(F.lit(1)).over(W.partitionBy())
    d = dates.select(date, k.alias("__k"), n.alias("__n"))
    n_train = F.least(F.col("__n") - 2, F.greatest(F.lit(1), F.floor(F.col("__n") * train)))
    n_valid = F.least(F.col("__n") - n_train - 1, F.greatest(F.lit(1), F.floor(F.col("__n") * valid)))
    split = (
        F.when(F.col("__n") < 3, "train")
        .when(F.col("__k") <= n_train, "train")
        .when(F.col("__k") <= n_train + n_valid, "valid")
        .otherwise("test")
    )
    return df.join(d.select(date, split.alias("split")), date, "left")


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "sample_id", train: float = 0.7, valid: float = 0.15, seed: int = 42
) -> DataFrame:
    """Per class, rows in a repeatable hash order cut at rounded quotas; every split gets a row when a class has three.

    A class is unbounded, so ranks come from the distributed order over (class, hash) minus the class start.
    """
    known = df.where(F.col(label).isNotNull()).withColumn("__h", hash_order(seed, key))
    pos = with_global_rank(known, [F.asc(label), F.asc("__h"), F.asc(key)], "__pos")
    sizes = pos.groupBy(label).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # last rows of train and of valid; what follows is test
    ends = sizes.withColumn("__train", _quota(F.col("__n"), train, F.col("__n"), 2))
    ends = ends.withColumn("__valid", F.col("__train") + _quota(F.col("__n"), valid, F.col("__n") - F.col("__train"), 1))
    nth = F.col("__pos") - F.col("__first") + 1
    split = F.when(nth <= F.col("__train"), "train").when(nth <= F.col("__valid"), "valid").otherwise("test")
    out = pos.join(ends.drop("__n"), label)  # one row per class on the right
    return out.withColumn("split", split).select(*df.columns, "split")


def _quota(n: Column, share: float, left: Column, later: int) -> Column:
    """Rounded share of ``n`` rows, of which ``left`` are not dealt yet: at least one while there is any, and one is left
    for each of the ``later`` splits if there are enough."""
    most = F.greatest(left - later, F.least(left, F.lit(1)))
    return F.least(F.greatest(F.bround(n * share).cast("bigint"), F.lit(1)), most)


def walk_forward(
    spark: SparkSession, n: int, train_size: int, test_size: int, step: int | None = None, expanding: bool = True
) -> DataFrame:
    """Fold bounds (fold, train_start, train_end, test_start, test_end), ends exclusive, over n ordered positions."""
    if min(n, train_size, test_size) <= 0:
        raise ValueError("sizes must be positive")
    stride = test_size if step is None else step
    if stride <= 0:
        raise ValueError("step must be positive")
    folds = max(0, (n - test_size - train_size) // stride + 1)
    f = F.col("id")
    start = F.lit(train_size) + f * stride
    return spark.range(folds).select(
        f.cast("int").alias("fold"),
        (F.lit(0) if expanding else start - train_size).cast("bigint").alias("train_start"),
        start.alias("train_end"),
        start.alias("test_start"),
        (start + test_size).alias("test_end"),
    )


def fold_members(panel: DataFrame, position: str, folds: DataFrame, block: int) -> DataFrame:
    """Rows of a panel per fold and role.

    Positions meet folds on blocks of positions, so the fold table is exploded by its own length and joined by key.
    """
    spans = folds.select(
        "fold",
        F.inline(
            F.array(
                F.struct(F.lit("train").alias("role"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi")),
                F.struct(F.lit("test").alias("role"), F.col("test_start").alias("lo"), F.col("test_end").alias("hi")),
            )
        ),
    )
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    rows = panel.withColumn("__b", F.floor(F.col(position) / block))
    hit = (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))
    return rows.join(spans, "__b").where(hit).drop("__b", "lo", "hi")
