"""Evaluation metrics as DataFrames.

Curve metrics (AUC, average precision) and rank correlation need the rows in score order.  Scores are counted per
distinct value first, which settles ties exactly, and the ordered totals come from ``with_running_totals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import non_zero, ratio
from barloom.functions.ordering import exact_quantiles, take_first, with_running_totals

QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _point_metrics(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.withColumns(
        {
            "samples": tp + fp + fn + tn,
            "accuracy": _div(tp + tn, tp + fp + fn + tn),
            "precision": precision,
            "recall": recall,
            "f1": _div(2 * precision * recall, precision + recall),
        }
    )


def score_sums(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: the confusion counts at ``threshold`` and the sums behind the curves, all from one count per score."""
    clean = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    per = clean.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n")
    )
    run = with_running_totals(per, "s", {"cp": "p", "cn": "n"}, ascending=False)
    above = F.col("s") >= threshold
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = run.agg(
        total("p").alias("P"),
        total("n").alias("N"),
        total(F.when(above, F.col("p"))).alias("tp"),
        total(F.when(above, F.col("n"))).alias("fp"),
        # pairs where the negative scores lower, ties count half
        F.sum(F.col("n").cast("double") * (F.col("cp") - F.col("p") + F.col("p") / 2)).alias("area"),
        F.sum(ratio(F.col("cp"), F.col("cp") + F.col("cn")) * F.col("p")).alias("ap"),
    )
    two = (F.col("P") > 0) & (F.col("N") > 0)
    return sums.select(
        "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
        F.when(two, F.try_divide("area", F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.when(two, F.try_divide("ap", F.col("P"))).alias("pr_auc"),
    )


def curve_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact ROC AUC and average precision; NULL when only one class occurs."""
    return score_sums(df, y, score).select("auc", "pr_auc")


def classification_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    return _point_metrics(score_sums(df, y, score, threshold)).select("accuracy", "precision", "recall", "f1", "auc")


def extended_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> DataFrame:
    base = _point_metrics(score_sums(df, y, score, threshold))
    return base.select(
        "samples",
        _div(F.col("tp") + F.col("fn"), F.col("samples")).alias("positive_rate"),
        "accuracy", "precision", "recall", "f1",
        F.col("auc").alias("roc_auc"), "pr_auc", "tn", "fp", "fn", "tp",
    )


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    err = F.col(y) - F.col(pred)
    return df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(err * err), non_zero(F.var_pop(y)))).alias("r2"),
    )


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank of each distinct value of a column over the whole table."""
    per = df.groupBy(F.col(column).alias(column)).agg(F.count(F.lit(1)).alias("__c"))
    run = with_running_totals(per, column, {"__cum": "__c"})
    return run.select(column, (F.col("__cum") - (F.col("__c") - 1) / 2).alias(name))


def information_coefficient(df: DataFrame, y: str, score: str, rank: bool = False) -> DataFrame:
    """Pearson, or Spearman through average ranks, over rows where both are known."""
    clean = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(y, score)
    if not rank:
        return clean.agg(F.corr(y, score).alias("ic"))
    # counts per pair keep a repeated value from being one huge join group
    pairs = clean.groupBy(y, score).agg(F.count(F.lit(1)).alias("__w"))
    out = pairs.join(average_ranks(clean, y, "__ry"), y).join(average_ranks(clean, score, "__rs"), score)
    w, a, b = F.col("__w"), F.col("__ry"), F.col("__rs")
    s = out.agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"),
    )
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return s.select(F.try_divide(cov, F.sqrt(va * vb)).alias("ic"))


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, population std, range and exact quantiles of a whole column."""
    base = df.agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    return base.join(exact_quantiles(df, column, QUANTILES))  # one-row sides


def performance(df: DataFrame, entity: str, time: str, ret: str, periods_per_year: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe and drawdown per return series.

    A series has one return per period, so the running wealth is a calendar-bounded window.  A return of -1 leaves
    nothing from then on, and one below -1 turns the sign; an annual return of negative wealth is unknown.
    """
    spec = W.partitionBy(entity).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    growth = F.col(ret) + 1

    def product(over=lambda c: c):
        size = F.exp(over(F.sum(F.log(F.abs(F.when(growth != 0, growth))))))
        sign = 1 - 2 * (over(F.count_if(growth < 0)) % 2)
        return F.when(over(F.count_if(growth == 0)) > 0, F.lit(0.0)).otherwise(sign * size)

    wealth = df.where(F.col(ret).isNotNull()).withColumn("__w", product(lambda c: c.over(spec)))
    wealth = wealth.withColumn("__peak", F.max("__w").over(spec))
    out = wealth.groupBy(entity).agg(
        product().alias("__total"),
        F.count(ret).alias("__n"),
        F.stddev_pop(ret).alias("__sd"),
        F.avg(ret).alias("__mean"),
        F.min(F.try_divide(F.col("__w"), F.col("__peak")) - 1).alias("max_drawdown"),
    )
    year = F.lit(float(periods_per_year))
    return out.select(
        entity,
        (F.col("__total") - 1).alias("total_return"),
        (F.pow(F.when(F.col("__total") >= 0, F.col("__total")), year / F.col("__n")) - 1).alias("annual_return"),
        (F.col("__sd") * F.sqrt(year)).alias("volatility"),
        (F.try_divide(F.col("__mean"), non_zero(F.col("__sd"))) * F.sqrt(year)).alias("sharpe"),
        "max_drawdown",
    )


def temporal_split_summary(df: DataFrame) -> DataFrame:
    """First and last date and rows of train, valid and test, empty ones included."""
    names = df.sparkSession.sql("select posexplode(array('train', 'valid', 'test')) as (ord, split)")
    per = df.groupBy("split").agg(
        F.min("asof_date").alias("date_min"), F.max("asof_date").alias("date_max"), F.count(F.lit(1)).alias("samples")
    )
    return names.join(per, "split", "left").na.fill(0, ["samples"]).orderBy("ord").drop("ord")


def check_temporal_split(summary: DataFrame) -> None:
    """Error unless all splits have rows and train < valid < test in time."""
    s = {r["split"]: r for r in summary.collect()}  # three rows
    empty = [k for k in ("train", "valid", "test") if not s.get(k) or s[k]["samples"] == 0]
    if empty:
        raise ValueError(f"empty splits: {empty}")
    if not s["train"]["date_max"] < s["valid"]["date_min"]:
        raise ValueError("train must end before valid starts")
    if not s["valid"]["date_max"] < s["test"]["date_min"]:
        raise ValueError("valid must end before test starts")


def extremes(df: DataFrame, score: str, n: int, key: str = "sample_id") -> DataFrame:
    """Top and bottom n rows by score, tagged."""
    top = take_first(df, [F.desc(score), F.asc(key)], n).withColumn("part", F.lit("top"))
    low = take_first(df, [F.asc(score), F.asc(key)], n).withColumn("part", F.lit("bottom"))
    return top.unionByName(low)


def validation_errors(df: DataFrame, y: str, score: str, n: int, threshold: float = 0.5, key: str = "sample_id") -> DataFrame:
    """The most confident false positives and false negatives."""
    pred = F.col(score) >= threshold
    fp = take_first(df.where((F.col(y) == 0) & pred), [F.desc(score), F.asc(key)], n).withColumn("part", F.lit("false_positive"))
    fn = take_first(df.where((F.col(y) == 1) & ~pred), [F.asc(score), F.asc(key)], n).withColumn("part", F.lit("false_negative"))
    return fp.unionByName(fn)


def class_means(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.agg(
        F.avg(F.when(F.col(y) == 1, F.col(score))).alias("positive_mean_score"),
        F.avg(F.when(F.col(y) == 0, F.col(score))).alias("negative_mean_score"),
    )
