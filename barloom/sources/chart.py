"""Chart payloads (JSON with parallel arrays and event maps) to bars and corporate actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import instrument_id, split_ratio
from barloom.session import stored

PAYLOAD_SCHEMA = """
chart struct<
  error: string,
  result: array<struct<
    timestamp: array<bigint>,
    indicators: struct<
      quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>,
                          volume: array<double>>>,
      adjclose: array<struct<adjclose: array<double>>>>,
    events: struct<
      dividends: map<string, struct<date: bigint, amount: double>>,
      splits: map<string, struct<date: bigint, numerator: double, denominator: double, splitRatio: string>>>>>>
"""


def utc_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


@dataclass
class Payloads:
    """Parsed payloads (symbol, r) and those set aside (symbol, reason)."""

    good: DataFrame
    rejected: DataFrame


def _checked(df: DataFrame, payload: str) -> DataFrame:
    """(symbol, r, reason): the first result of each payload, or why there is none."""
    parsed = df.select(F.upper("symbol").alias("symbol"), F.col(payload).alias("__t"), F.from_json(payload, f"{PAYLOAD_SCHEMA.strip()}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("__p"))
    first = F.get("__p.chart.result", F.lit(0))
    reason = (
        F.when(F.col("__t").isNull() | (F.trim("__t") == ""), F.lit("payload is empty"))
        .when(F.col("__p").isNull() | F.col("__p.__bad").isNotNull(), F.lit("payload is not the JSON of a chart"))
        .when(F.col("__p.chart").isNull(), F.lit("payload has no chart"))
        .when(F.col("__p.chart.error").isNotNull(), F.col("__p.chart.error"))
        .when(F.coalesce(F.size("__p.chart.result"), F.lit(0)) <= 0, F.lit("chart payload has no result"))
        .when(first.isNull(), F.lit("chart payload has an empty result"))
    )
    return parsed.select("symbol", first.alias("r"), reason.alias("reason"))


def split_payloads(df: DataFrame, payload: str = "payload") -> Payloads:
    """Good payloads and bad ones with their reason; the JSON is parsed once and the outcome stored."""
    both = stored(_checked(df, payload))
    return Payloads(both.where("reason is null").drop("reason"), both.where("reason is not null").select("symbol", "reason"))


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows (symbol, r); a payload with an error, or without a result, stops the job.  See ``split_payloads`` for going on."""
    why = F.concat(F.col("symbol"), F.lit(": "), F.col("reason"))
    return _checked(df, payload).select("symbol", F.when(F.col("reason").isNotNull(), F.raise_error(why)).otherwise(F.col("r")).alias("r"))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def _by_date(events: Column, value) -> Column:
    """Map from UTC date to event value; a later event on the same date wins."""
    pairs = F.transform(F.map_values(events), lambda e: F.named_struct(F.lit("d"), utc_date(e["date"]), F.lit("v"), value(e)))
    return F.coalesce(pairs, F.array())


def _last_on(pairs: Column, day: Column) -> Column:
    same = F.filter(pairs, lambda p: p["d"] == day)
    return F.when(F.size(same) > 0, F.element_at(same, -1)["v"])


def _ratio(e: Column) -> Column:
    return split_ratio(e["numerator"], e["denominator"], e["splitRatio"])


def daily_prices(df: DataFrame, source: str = "chart", payload: str = "payload") -> DataFrame:
    """One row per timestamp of payloads in JSON; a bad one stops the job."""
    return prices_of(parse_payloads(df, payload), source)


def prices_of(r: DataFrame, source: str = "chart") -> DataFrame:
    """One row per timestamp of parsed payloads.  The arrays belong to one symbol's calendar, so an exploded payload stays small."""
    quote = F.get("r.indicators.quote", F.lit(0))
    adj = F.get("r.indicators.adjclose", F.lit(0))["adjclose"]
    rows = r.select(
        "symbol",
        quote.alias("q"),
        adj.alias("adj"),
        _by_date(F.col("r.events.dividends"), lambda e: e["amount"]).alias("dv"),
        _by_date(F.col("r.events.splits"), _ratio).alias("sp"),
        F.posexplode("r.timestamp").alias("i", "seconds"),
    ).withColumn("trade_date", utc_date(F.col("seconds")))
    i = F.col("i")
    return rows.select(
        instrument_id(F.lit("US"), "symbol").alias("instrument_id"),
        "symbol",
        F.lit("US").alias("market"),
        "trade_date",
        *[_at(F.col(f"q.{c}"), i).alias(c) for c in ("open", "high", "low", "close", "volume")],
        _at(F.col("adj"), i).alias("adj_close"),
        _last_on(F.col("dv"), F.col("trade_date")).alias("dividends"),
        _last_on(F.col("sp"), F.col("trade_date")).alias("stock_splits"),
        F.lit(source).alias("source"),
    )


def corporate_actions(df: DataFrame, source: str = "chart", payload: str = "payload") -> DataFrame:
    """One row per dividend and per split of payloads in JSON; a bad one stops the job."""
    return actions_of(parse_payloads(df, payload), source)


def actions_of(r: DataFrame, source: str = "chart") -> DataFrame:
    """One row per dividend and per split of parsed payloads; ``action_table`` orders them."""
    make = lambda events, kind, value: F.coalesce(
        F.transform(
            F.map_values(events),
            lambda e: F.struct(
                utc_date(e["date"]).alias("action_date"), F.lit(kind).alias("action_type"), value(e).alias("value")
            ),
        ),
        F.array(),
    )
    both = F.concat(
        make(F.col("r.events.dividends"), "dividend", lambda e: e["amount"]),
        make(F.col("r.events.splits"), "stock_split", _ratio),
    )
    return r.select("symbol", F.inline(both)).select(
        instrument_id(F.lit("US"), "symbol").alias("instrument_id"),
        "symbol",
        F.lit("US").alias("market"),
        "action_date",
        "action_type",
        "value",
        F.lit(source).alias("source"),
    )


def action_table(actions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Actions of a date range in symbol, date, type order."""
    if start:
        actions = actions.where(F.col("action_date") >= F.lit(start).cast("date"))
    if end:
        actions = actions.where(F.col("action_date") <= F.lit(end).cast("date"))
    return actions.orderBy("symbol", "action_date", "action_type")
