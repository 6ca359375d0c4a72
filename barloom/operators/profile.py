"""Profiles of training datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordering import column_quantiles

SPLITS = ["train", "valid", "test"]


def label_by_split(df: DataFrame) -> DataFrame:
    """Label counts with one column per split."""
    return df.groupBy("label").pivot("split", SPLITS).count().na.fill(0, SPLITS)


def split_method(df: DataFrame) -> DataFrame:
    """One row: whether the splits are ordered in time."""
    m = df.agg(
        *[F.min(F.when(F.col("split") == s, F.col("asof_date"))).alias(f"{s}_min") for s in SPLITS],
        *[F.max(F.when(F.col("split") == s, F.col("asof_date"))).alias(f"{s}_max") for s in SPLITS],
    )
    overlap = F.coalesce(F.col("train_max") > F.col("valid_min"), F.lit(False)) | F.coalesce(F.col("valid_max") > F.col("test_min"), F.lit(False))
    some = F.coalesce("train_min", "valid_min", "test_min").isNotNull()
    return m.select(F.when(some & ~overlap, "time_by_asof_date").otherwise("unknown").alias("split_method"))


def training_snapshot(df: DataFrame) -> DataFrame:
    """One row describing a training table, to append to a table of runs."""
    pos = F.when(F.col("label").isNotNull(), (F.col("label") == 1).cast("double"))
    in_split = lambda s: F.col("split") == s
    row = df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count_if(in_split(s)).alias(f"n_{s}") for s in SPLITS],
        F.avg(pos).alias("positive_ratio_all"),
        *[F.avg(F.when(in_split(s), pos)).alias(f"positive_ratio_{s}") for s in SPLITS],
        F.min("asof_date").alias("date_min"),
        F.max("asof_date").alias("date_max"),
        F.count_distinct("ts_code").alias("n_codes"),
        # the number of label sources is set by the label builder
        F.array_join(F.sort_array(F.collect_set("label_source")), "|").alias("label_source"),
    )
    return row.join(split_method(df))  # one-row sides


def append_run(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").parquet(path)


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share, constancy, variance and exact quartiles per feature.

    Counts and moments come from one aggregate, the quartiles of all features from one ordering.
    """
    row = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[f(c).alias(f"{k}__{c}") for c in columns for k, f in (
            ("n", F.count), ("var", F.var_pop), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
    )
    per = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n__{c}").alias("n"), *[F.col(f"{k}__{c}").cast("double").alias(k) for k in ("var", "mean", "std", "min", "max")])
        for c in columns
    ]))
    base = row.select("__n", per.alias("f")).select("__n", "f.*")
    distinct = F.when(F.col("n") == 0, 0).when(F.col("min") == F.col("max"), 1).otherwise(2)
    missing = F.col("__n") - F.col("n")
    base = base.select(
        "feature",
        missing.alias("missing_count"),
        (missing / F.col("__n")).alias("missing_ratio"),
        (distinct + (missing > 0).cast("int") <= 1).alias("is_constant"),
        F.col("var").alias("variance"), "mean", "std", "min", "max",
    )
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75]).select(F.col("column").alias("feature"), F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return base.join(quartiles, "feature", "left")


def dataset_shape(meta: DataFrame, features: DataFrame) -> DataFrame:
    """Row counts, repeated feature ids, ids on one side only, and the positive share."""
    ids = features.groupBy("sample_id").count()
    both = meta.select("sample_id", "label", F.lit(1).alias("__m")).join(ids.withColumn("__f", F.lit(1)), "sample_id", "full")
    return both.agg(
        F.count("__m").alias("meta_rows"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("feature_rows"),
        F.coalesce(F.sum(F.greatest(F.col("count") - 1, F.lit(0))), F.lit(0)).alias("repeated_ids"),
        F.count_if(F.col("__m").isNull() | F.col("__f").isNull()).alias("unmatched_ids"),
        F.avg("label").alias("positive_ratio"),
    )
