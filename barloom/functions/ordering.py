"""Global order without a single-task window.

``row_number() over (order by ...)`` and running totals over a whole table would move every row into one task.  Here
the rows are range-partitioned on the full sort key, numbered inside their partition, and shifted by the totals of the
partitions before them.  The partitioned rows are checkpointed once, so both passes see the same partitions even when
executors are lost in between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

_BITS = 33


def _spread(df: DataFrame, order: list[Column]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    mid = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", mid).checkpoint()
    return placed.withColumns(
        {
            "__p": F.shiftright("__m", _BITS),
            "__i": F.col("__m").bitwiseAND(F.lit((1 << _BITS) - 1)),
        }
    )


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add 1..N in the given order (the order must be total to be repeatable)."""
    placed = _spread(df, order)
    # one row per partition: bounded by the shuffle partition count
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return (
        placed.join(F.broadcast(offsets), "__p")
        .withColumn(name, F.col("__i") + F.col("__o") + F.lit(1))
        .drop("__p", "__i", "__m", "__o")
    )


def with_running_totals(df: DataFrame, key: str, sums: dict[str, str], ascending: bool = True) -> DataFrame:
    """Add inclusive running totals of ``sums`` (output -> column) over distinct values of ``key`` in order.

    ``key`` must be unique in ``df`` (aggregate first), which keeps range partitions even and partition windows small.
    """
    order = F.col(key).asc() if ascending else F.col(key).desc()
    placed = _spread(df, [order])
    totals = placed.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "__p", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums]
    )
    inside = W.partitionBy("__p").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__p")
    out = out.withColumns({o: F.sum(c).over(inside) + F.col(f"__o_{o}") for o, c in sums.items()})
    return out.drop("__p", "__i", "__m", *[f"__o_{o}" for o in sums])


def take_first(df: DataFrame, order: list[Column], n: int, task_limit: int = 100_000) -> DataFrame:
    """First ``n`` rows in order; a large ``n`` is cut by global rank instead of a single-task limit."""
    if n <= task_limit:
        return df.orderBy(*order).limit(n)
    return with_global_rank(df, order, "__rank").where(F.col("__rank") <= n).drop("__rank")


def exact_quantiles(df: DataFrame, column: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """One row with exact linear quantiles of a whole column.

    Values are counted first, then ordered across partitions; only the rows that cover a wanted position are kept.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    run = with_running_totals(counts, "__v", {"__cum": "__c"}).checkpoint()
    n = run.agg(F.max("__cum")).first()[0] or 0
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p) * (n - 1))
        lo, hi = F.floor(pos), F.ceil(pos)
        covers = lambda k: (F.col("__cum") > k) & (F.col("__cum") - F.col("__c") <= k)
        picks += [
            F.max(F.when(covers(lo), F.col("__v"))).alias(f"__lo{i}"),
            F.max(F.when(covers(hi), F.col("__v"))).alias(f"__hi{i}"),
            F.max(pos - lo).alias(f"__w{i}"),
        ]
    row = run.agg(*picks)
    names = [f"{prefix}{int(round(p * 100))}" for p in probs]
    return row.select(
        *[
            (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__w{i}")).alias(n)
            for i, n in enumerate(names)
        ]
    )


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linear quantiles of many columns: (column, n, q0, q1, ...), one row per column that has a value.

    One table of (column, value, count) is put in order of column and value; running counts are carried over partitions
    per column, so neither a column nor a frequent value is a task of its own.  NaN counts as missing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]))
    counts = df.select(each.alias("p")).select("p.c", "p.v").where("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = _spread(counts, [F.col("c"), F.col("v")])
    # one row per column and partition that holds some of it: no more than columns and partitions together
    sizes = placed.groupBy("__p", "c").agg(F.sum("n").alias("__t"))
    before = W.partitionBy("c").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("c")
    sizes = sizes.select("__p", "c", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"), F.sum("__t").over(whole).alias("__n"))
    inside = W.partitionBy("__p", "c").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    run = placed.join(F.broadcast(sizes), ["__p", "c"]).withColumn("__cum", F.sum("n").over(inside) + F.col("__o"))
    covers = lambda k: (F.col("__cum") > k) & (F.col("__cum") - F.col("n") <= k)
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        picks += [F.max(F.when(covers(F.floor(at)), F.col("v"))).alias(f"lo{i}"), F.max(F.when(covers(F.ceil(at)), F.col("v"))).alias(f"hi{i}"), F.max(at - F.floor(at)).alias(f"w{i}")]
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1).alias("column")
    values = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(probs))]
    return run.groupBy("c").agg(F.max("__n").alias("n"), *picks).select(name, "n", *values)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
