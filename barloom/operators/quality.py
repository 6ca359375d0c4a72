"""Checks on price tables, labels, and labels against bars.  Every report is a DataFrame of aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import holds, lenient_date, sample_id
from barloom.operators.schema import duplicate_rows, require_columns
from barloom.session import stored

QUALITY_COLUMNS = ["open", "high", "low", "close", "volume", "adj_close"]
PRICES = ["open", "high", "low", "close"]


def anomaly_rules() -> dict[str, Column]:
    c = F.col
    return {
        "high_less_than_low": c("high") < c("low"),
        "close_non_positive": c("close") <= 0,
        "adj_close_non_positive": c("adj_close") <= 0,
        "volume_negative": c("volume") < 0,
        "ohlc_non_positive": reduce(lambda a, b: a | b, [holds(c(p) <= 0) for p in PRICES]),
    }


def symbol_history(df: DataFrame) -> DataFrame:
    """Rows, first and last date per symbol; a missing symbol is a group of its own."""
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"),
    )


def extreme_histories(history: DataFrame, n: int = 20, longest: bool = False) -> DataFrame:
    order = F.desc("rows") if longest else F.asc("rows")
    return history.orderBy(order, "symbol").limit(n)


def late_symbols(history: DataFrame, expected_start: str, tolerance_days: int = 7) -> DataFrame:
    return history.where(F.col("first_trade_date") > F.date_add(F.lit(expected_start).cast("date"), tolerance_days))


def _unpivot(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row.select(F.expr(f"stack({len(names)}, {pairs}) as ({key}, {value})"))


def missing_rates(df: DataFrame, columns: list[str] = QUALITY_COLUMNS) -> DataFrame:
    names = [c for c in columns if c in df.columns]
    row = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in names])
    return _unpivot(row, names, "column_name", "missing_rate")


def anomaly_counts(df: DataFrame) -> DataFrame:
    rules = anomaly_rules()
    row = df.agg(*[F.count_if(holds(c)).alias(n) for n, c in rules.items()])
    return _unpivot(row, list(rules), "anomaly", "row_count")


def anomaly_examples(df: DataFrame, n: int = 20) -> DataFrame:
    """First rows of each anomaly in symbol, date order."""
    rules = anomaly_rules()
    hit = F.array_compact(F.array(*[F.when(holds(c), F.lit(name)) for name, c in rules.items()]))
    rows = df.select("*", F.explode(hit).alias("anomaly"))
    rn = F.row_number().over(W.partitionBy("anomaly").orderBy("symbol", "trade_date", "ord"))
    return rows.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def unsorted_symbols(df: DataFrame, ordinal: str) -> DataFrame:
    """Symbols with a date below an earlier row's date in ingest order.

    Ingest order may hold any number of rows per symbol, so the check is not a window over rows: a symbol is unsorted
    exactly when some date's first ordinal comes before an earlier date's last ordinal, and there is at most one row
    per symbol and day after the first aggregate.
    """
    days = df.groupBy("symbol", "trade_date").agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    prev = F.max("hi").over(W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, -1))
    return days.withColumn("__prev", prev).where(F.col("lo") < F.col("__prev")).select("symbol").distinct()


def report_state(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row per symbol with all that the price report counts, from one scan.

    Rows are counted per symbol and day first, so a hot symbol is its days when it is put together.
    """
    columns = [c for c in QUALITY_COLUMNS if c in df.columns]
    days = df.groupBy("symbol", "trade_date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        *[F.count_if(holds(rule)).alias(f"bad_{name}") for name, rule in anomaly_rules().items()],
        *([F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi")] if ordinal else []),
    )
    if ordinal:
        prev = F.max("hi").over(W.partitionBy("symbol").orderBy("trade_date").rowsBetween(W.unboundedPreceding, -1))
        days = days.withColumn("late", holds(F.col("lo") < prev))
    return days.groupBy("symbol").agg(
        F.sum("n").alias("rows"),
        F.min("trade_date").alias("first_trade_date"),
        F.max("trade_date").alias("last_trade_date"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("repeated"),
        *[F.sum(c).alias(c) for c in days.columns if c.startswith(("null_", "bad_"))],
        *([F.max("late").alias("unsorted")] if ordinal else []),
    )


def price_report(
    df: DataFrame, expected_start: str, tolerance_days: int = 7, ordinal: str | None = None, warn_rate: float = 0.05
) -> DataFrame:
    """The validation report in long form: (section, name, value).  The input is scanned once; every section is read from
    the stored rows per symbol."""
    require_columns(df, ["symbol", "trade_date", *PRICES, "volume"])
    state = stored(report_state(df, ordinal))
    columns, rules = [c for c in QUALITY_COLUMNS if c in df.columns], list(anomaly_rules())
    late = holds(F.col("first_trade_date") > F.date_add(F.lit(expected_start).cast("date"), tolerance_days))
    total = state.agg(
        F.sum("rows").alias("rows"),
        F.count("symbol").alias("symbols"),
        F.min("first_trade_date").cast("string").alias("date_min"),
        F.max("last_trade_date").cast("string").alias("date_max"),
        F.count_if(late).alias("symbols_starting_late"),
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicate_rows"),
        *([F.count_if(F.col("unsorted") & F.col("symbol").isNotNull()).alias("unsorted_symbols")] if ordinal else []),
        *[F.coalesce(F.sum(f"null_{c}") / F.sum("rows"), F.lit(0.0)).alias(f"null_{c}") for c in columns],
        *[F.coalesce(F.sum(f"bad_{r}"), F.lit(0)).alias(f"bad_{r}") for r in rules],
    )
    line = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    summary = ["rows", "symbols", "date_min", "date_max", "symbols_starting_late", "duplicate_rows", *(["unsorted_symbols"] if ordinal else [])]
    lines = [
        *[line("summary", n, F.col(n)) for n in summary],
        *[line("missing_rate", c, F.format_string("%.6f", F.col(f"null_{c}"))) for c in columns],
        *[line("anomaly", r, F.col(f"bad_{r}")) for r in rules],
        *[F.when(F.col(f"null_{c}") > warn_rate, line("warning", c, F.lit("missing"))) for c in columns],
        *[F.when(F.col(f"bad_{r}") > 0, line("warning", r, F.lit("anomaly"))) for r in rules],
    ]
    out = total.select(F.inline(F.array_compact(F.array(*lines))))
    for section, longest in (("shortest", False), ("longest", True)):
        ends = extreme_histories(state, 20, longest)
        out = out.unionByName(ends.select(F.lit(section).alias("section"), F.col("symbol").alias("name"), F.col("rows").cast("string").alias("value")))
    return out


def label_report(df: DataFrame, *, require_sample_id: bool = True, allowed: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Counts of unreadable dates, repeated ids, missing and unknown labels."""
    require_columns(df, (["sample_id"] if require_sample_id else []) + ["ts_code", "asof_date", "label"])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lenient_date("asof_date").isNull()).alias("invalid_dates"),
        F.count_if(F.col("label").isNull()).alias("null_labels"),
        F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(*allowed)).alias("invalid_labels"),
    )
    if require_sample_id:
        row = row.join(_repeats(df, ["sample_id"], "duplicate_sample_ids"))  # one-row sides
    return row


def _repeats(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(name))


def daily_schema_report(df: DataFrame) -> DataFrame:
    require_columns(df, ["trade_date", *PRICES, "vol"])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(lenient_date("trade_date").isNull()).alias("invalid_dates")
    )


def daily_quality(df: DataFrame) -> DataFrame:
    """Rule violations per symbol, all rules at once."""
    c = F.col
    bad = {f"bad_{p}": c(p).isNull() | (c(p) <= 0) for p in PRICES}
    bad["high_below"] = holds(c("high") < c("low")) | holds(c("high") < c("open")) | holds(c("high") < c("close"))
    bad["low_above"] = holds(c("low") > c("open")) | holds(c("low") > c("close"))
    bad["bad_vol"] = c("vol").isNull() | (c("vol") < 0)
    if "amount" in df.columns:
        bad["bad_amount"] = c("amount").isNull() | (c("amount") < 0)
    per = df.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(cond).alias(n) for n, cond in bad.items()],
        (F.count("trade_date") - F.count_distinct("trade_date")).alias("duplicate_dates"),
    )
    return per


def label_alignment(labels: DataFrame, bars: DataFrame, min_history: int) -> DataFrame:
    """Labels with an issue: symbol missing, as-of outside the symbol's dates, or too few bars up to it."""
    from barloom.operators.history import locate

    span = bars.groupBy("ts_code").agg(F.min("trade_date").alias("daily_start"), F.max("trade_date").alias("daily_end"))
    found = locate(labels.where("asof_date is not null"), bars).join(span, "ts_code", "left")
    issue = (
        F.when(F.col("daily_start").isNull(), "missing_symbol")
        .when((F.col("asof_date") < F.col("daily_start")) | (F.col("asof_date") > F.col("daily_end")), "asof_not_covered")
        .when(F.col("pos") < min_history, "insufficient_history")
    )
    return found.withColumn("issue", issue).where("issue is not null").select(
        "ts_code", "asof_date", "issue", "daily_start", "daily_end", F.col("pos").alias("history_len")
    )


def contract_audit(labels: DataFrame, bars: DataFrame, min_history: int) -> DataFrame:
    """Label, bar and alignment checks as (part, name, severity, value)."""
    lab = labels.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("ts_code").isNull()).alias("null_ts_code"),
        F.count_if(F.col("asof_date").isNull()).alias("null_asof_date"),
        F.count_if(F.col("label").isNull()).alias("null_label"),
        F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)).alias("invalid_label"),
        F.count_if(holds(F.col("sample_id") != sample_id("ts_code", "asof_date"))).alias("inconsistent_sample_id"),
    )
    repeats = [
        _repeats(labels, ["sample_id"], "duplicate_sample_id").select(
            F.lit("duplicate_sample_id").alias("name"), F.col("duplicate_sample_id").alias("value")
        ),
        _repeats(labels, ["ts_code", "asof_date"], "d").select(F.lit("duplicate_code_date").alias("name"), F.col("d").alias("value")),
    ]
    day = bars.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("trade_date").isNull()).alias("invalid_trade_date"),
        *[F.count_if(holds(F.col(p) <= 0)).alias(f"nonpositive_{p}") for p in PRICES],
        F.count_if(holds(F.col("vol") < 0)).alias("negative_vol"),
    )
    soft = {"rows", "duplicate_sample_id", "duplicate_code_date", "asof_before_first", "history_too_short"}
    align = label_alignment(labels, bars, min_history).agg(
        F.count_if(F.col("issue") == "missing_symbol").alias("missing_symbol"),
        F.count_if(F.col("asof_date") < F.col("daily_start")).alias("asof_before_first"),
        F.count_if(F.col("issue") == "insufficient_history").alias("history_too_short"),
    )
    part = lambda d, p: d.select(F.lit(p).alias("part"), "name", "value")
    flat = [part(_unpivot(d, d.columns, "name", "value"), p) for d, p in ((lab, "labels"), (day, "daily"), (align, "alignment"))]
    dist = labels.groupBy("label").count().select(
        F.concat(F.lit("label_"), F.coalesce(F.col("label").cast("string"), F.lit("null"))).alias("name"),
        F.col("count").alias("value"),
    )
    out = reduce(DataFrame.unionByName, [*flat, *[part(r, "labels") for r in repeats], part(dist, "distribution")])
    severity = (
        F.when((F.col("value") == 0) | (F.col("part") == "distribution") | (F.col("name") == "rows"), "info")
        .when(F.col("name").isin(*soft), "warning")
        .otherwise("error")
    )
    return out.withColumn("severity", severity)


def folder_audit(df: DataFrame, required: tuple[str, ...] = ("trade_date", "open", "high", "low", "close")) -> DataFrame:
    """Per source file: rows, code, date range and whether the needed columns exist."""
    missing = [c for c in required if c not in df.columns]
    return df.groupBy("entity_file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts_code").alias("ts_code"),
        F.min("trade_date").alias("date_min"),
        F.max("trade_date").alias("date_max"),
    ).withColumns({"missing_columns": F.lit(",".join(missing)), "ok": F.lit(not missing) & (F.col("rows") > 0)})


def folder_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("ok")).alias("files_ok"),
        F.sum("rows").alias("total_rows"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.count_distinct("ts_code").alias("symbols"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
    )
