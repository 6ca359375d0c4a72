"""Ordering, top-k and selection of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.ordering import take_first, with_global_rank
from barloom.operators.schema import first_per_key


def symbols_filter(df: DataFrame, symbols: str | list[str] | None) -> DataFrame:
    """Keep the listed codes; an empty list keeps all."""
    items = symbols.split(",") if isinstance(symbols, str) else list(symbols or [])
    wanted = sorted({str(s).strip() for s in items if str(s).strip()})
    return df.where(F.col("ts_code").isin(wanted)) if wanted else df


def pushed_limit(df: DataFrame) -> int:
    """Largest rank limit that Spark itself applies before the shuffle of a ranking window."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group (a positive ``n``; else all rows are ranked).

    Up to ``pushed_limit`` rows Spark cuts each group before the shuffle.  Beyond it a group can be larger than a task:
    each input partition first keeps the n best of its share of a group, dealt by group and partition, and the rows left
    are ranked by the distributed order of group and ``order``, which should be total.
    """
    name = rank or "__rn"
    if n > pushed_limit(df):
        out = _ranked_across_tasks(_cut_by_partition(df, keys, order, n), keys, order, name).where(F.col(name) <= n)
    else:
        out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        out = out.where(F.col(name) <= n) if n > 0 else out
    return out if rank else out.drop(name)


def _cut_by_partition(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    part = df.withColumn("__part", F.spark_partition_id())
    rn = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    return part.withColumn("__in", rn).where(F.col("__in") <= n).drop("__in", "__part")


def _ranked_across_tasks(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank inside each group without a task per group: the global rank minus that of the group's first row."""
    placed = with_global_rank(df, [*[F.col(k).asc() for k in keys], *order], "__pos")
    first = placed.groupBy(*keys).agg(F.min("__pos").alias("__first")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    out = placed.join(first, same)  # a hot group is split on its side; the other has one row per group
    return out.withColumn(name, F.col("__pos") - F.col("__first") + 1).drop("__pos", "__first", *[f"__k_{k}" for k in keys])


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per_key(df, keys, order)


def hash_order(seed: int, *cols: str) -> Column:
    """Repeatable pseudo-random order of rows by key: the md5 of seed and key columns as text, which any engine has."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def spaced_selection(
    df: DataFrame,
    group: list[str],
    min_days: int,
    max_rows: int = 0,
    score: str = "candidate_score",
    date: str = "asof_date",
    tie: str = "sample_id",
) -> DataFrame:
    """Greedy walk by score down and date up; a row within ``min_days`` calendar days of a kept one is dropped.

    The walk is a fold over one symbol's candidates (at most one per day and window), so the list it needs is bounded
    by the calendar.
    """
    rest = [c for c in df.columns if c not in group]
    symbol = [g for g in group if g != "window"]
    order = [F.desc(score), F.asc(date), F.asc(tie)]
    if min_days <= 0:
        return top_per_group(df, symbol, order, max_rows)
    row = F.struct(
        (-F.col(score)).alias("__s"), F.col(date).alias("__d"), F.col(tie).alias("__t"), F.unix_date(date).alias("__n"), F.struct(*rest).alias("r")
    )
    packed = df.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kept = F.aggregate(
        "rows",
        F.expr("cast(array() as array<int>)"),
        lambda acc, x: F.when(F.exists(acc, lambda d: F.abs(x["__n"] - d) < min_days), acc).otherwise(
            F.array_append(acc, x["__n"])
        ),
    )
    # a date is kept at most once, by the first row of that date in walk order
    picked = packed.withColumn("kept", kept).select(*group, "kept", F.posexplode("rows").alias("__i", "x"))
    picked = picked.where(F.array_contains("kept", F.col("x.__n")))
    picked = first_per_key(picked.withColumn("__n", F.col("x.__n")), [*group, "__n"], [F.asc("__i")])
    out = picked.select(*group, "x.r.*")
    if max_rows > 0:
        out = top_per_group(out, symbol, order, max_rows)
    return out.select(*df.columns)


def select_candidates(
    df: DataFrame,
    stage: str | None = None,
    top_n: int = 100,
    sample: str = "top",
    score: str = "candidate_score",
    seed: int = 42,
    key: str = "sample_id",
) -> DataFrame:
    """Candidates for review: best by score, a repeatable random sample, or a round robin over years."""
    if sample not in ("top", "random", "year_stratified"):
        raise ValueError(f"unsupported sample mode: {sample}")
    if stage:
        df = df.where(F.col("pattern_stage") == stage) if "pattern_stage" in df.columns else df.limit(0)
    if sample == "year_stratified":
        return year_round_robin(df, top_n, score, key)
    order = [F.desc_nulls_last(score), F.asc(key)] if sample == "top" else [hash_order(seed, key).asc(), F.asc(key)]
    return take_first(df, order, top_n) if top_n > 0 else df.orderBy(*order)


def year_round_robin(df: DataFrame, limit: int, score: str, key: str = "sample_id") -> DataFrame:
    """The k-th best row of each year, years in order, until the limit.

    With a limit no year needs more than ``limit`` rows (see ``top_per_group``).
    """
    df = df.withColumn("sample_year", F.year("asof_date")).where("sample_year is not null")
    order = [F.desc_nulls_last(score), F.asc(key)]
    if limit > 0:
        ranked = top_per_group(df, ["sample_year"], order, limit, "year_rank")
        return take_first(ranked, [F.asc("year_rank"), F.asc("sample_year")], limit)
    return _ranked_across_tasks(df, ["sample_year"], order, "year_rank").orderBy("year_rank", "sample_year")


def distribution(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))
