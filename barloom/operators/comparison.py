"""Side-by-side comparison of two prediction sets aligned by ``align_predictions``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordering import take_first
from barloom.operators.metrics import classification_metrics, class_means, information_coefficient


def top_sets(aligned: DataFrame, top_n: int, key: str = "sample_id") -> DataFrame:
    """Keys in the top n of either model with membership flags."""
    a = take_first(aligned, [F.desc("score_a"), F.asc(key)], top_n).select(key, F.lit(True).alias("in_a"))
    b = take_first(aligned, [F.desc("score_b"), F.asc(key)], top_n).select(key, F.lit(True).alias("in_b"))
    return a.join(b, key, "full").na.fill(False, ["in_a", "in_b"])


def buckets(tops: DataFrame) -> DataFrame:
    """One row per (bucket, key): both tops, their overlap and the two differences."""
    names = F.array_compact(
        F.array(
            F.when(F.col("in_a"), F.lit("top_a")),
            F.when(F.col("in_b"), F.lit("top_b")),
            F.when(F.col("in_a") & F.col("in_b"), F.lit("overlap")),
            F.when(F.col("in_a") & ~F.col("in_b"), F.lit("only_a")),
            F.when(F.col("in_b") & ~F.col("in_a"), F.lit("only_b")),
        )
    )
    return tops.select("*", F.explode(names).alias("bucket"))


def overlap_summary(tops: DataFrame, top_n: int) -> DataFrame:
    n = F.count_if(F.col("in_a") & F.col("in_b"))
    return tops.agg(n.alias("overlap_count"), (n / F.lit(float(top_n))).alias("overlap_ratio"))


def future_by_bucket(tops: DataFrame, future: DataFrame, key: str = "sample_id") -> DataFrame:
    """Count, mean, exact median and population std of the future return per bucket.

    A bucket holds at most 2n keys (the two top lists), so the exact median has a bounded input.
    """
    rows = buckets(tops).join(future.where("future_return is not null"), key)
    stats = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("future_return").alias("mean"),
        F.percentile("future_return", F.lit(0.5)).alias("median"),
        F.stddev_pop("future_return").alias("std"),
    )
    all_names = tops.sparkSession.sql("select explode(array('top_a', 'top_b', 'overlap', 'only_a', 'only_b')) as bucket")
    return all_names.join(stats, "bucket", "left").na.fill(0, ["row_count"])


def disagreement(aligned: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """Rows where one model is most above the other, both ways."""
    d = aligned.withColumn("delta", F.col("score_a") - F.col("score_b"))
    up = take_first(d, [F.desc("delta"), F.asc(key)], n).withColumn("part", F.lit("a_more_bullish"))
    down = take_first(d, [F.asc("delta"), F.asc(key)], n).withColumn("part", F.lit("b_more_bullish"))
    return up.unionByName(down)


def error_overlap(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows wrong in both models, in one only, and labels that differ between the two inputs."""
    wrong_a = (F.col("score_a") >= threshold).cast("int") != F.col("y_true_a")
    wrong_b = (F.col("score_b") >= threshold).cast("int") != F.col("y_true_a")
    return aligned.agg(
        F.count_if(wrong_a & wrong_b).alias("common_errors"),
        F.count_if(wrong_a & ~wrong_b).alias("only_a_errors"),
        F.count_if(wrong_b & ~wrong_a).alias("only_b_errors"),
        F.count_if(F.col("y_true_a") != F.col("y_true_b")).alias("label_mismatch"),
    )


def compare_report(aligned: DataFrame, top_n: int, threshold: float = 0.5) -> DataFrame:
    """Main comparison figures as (metric, value), with the winner of accuracy, f1 and AUC as text."""
    tops = top_sets(aligned, top_n)
    long = lambda df: df.select(F.expr(f"stack({len(df.columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, cast({c} as double)' for c in df.columns)}) as (metric, value)"))
    tag = lambda df, t: df.select(*[F.col(c).alias(f"{t}_{c}") for c in df.columns])
    ma = classification_metrics(aligned, "y_true_a", "score_a", threshold)
    mb = classification_metrics(aligned, "y_true_a", "score_b", threshold)
    both = tag(ma, "a").join(tag(mb, "b"))  # one-row sides
    win = lambda m: F.when(F.col(f"a_{m}") > F.col(f"b_{m}"), 1.0).when(F.col(f"a_{m}") < F.col(f"b_{m}"), -1.0).otherwise(0.0)
    both = both.withColumns({f"winner_{m}": win(m) for m in ("accuracy", "f1", "auc")})
    gaps = [
        tag(class_means(aligned, "y_true_a", f"score_{m}"), m).withColumn(
            f"{m}_gap", F.col(f"{m}_positive_mean_score") - F.col(f"{m}_negative_mean_score")
        )
        for m in ("a", "b")
    ]
    parts = [
        long(aligned.agg(F.count(F.lit(1)).alias("rows_aligned"))),
        long(information_coefficient(aligned, "score_a", "score_b").withColumnRenamed("ic", "pearson")),
        long(information_coefficient(aligned, "score_a", "score_b", True).withColumnRenamed("ic", "spearman")),
        long(overlap_summary(tops, top_n)),
        long(error_overlap(aligned, threshold)),
        long(both),
        *[long(g) for g in gaps],
    ]
    return reduce(DataFrame.unionByName, parts)
