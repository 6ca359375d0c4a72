"""Query registry: each entry pairs a Spark query with an independent SQL statement for the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# bars, written for the SQL side independently of sources.bars
BARS_SQL = """
with bar_d as (select l_suppkey, cast(l_shipdate as date) as trade_date, count(*) as n,
                  sum(cast(round(l_discount * 100) as bigint)) as disc,
                  sum(cast(round(l_quantity) as bigint)) as vol,
                  sum(cast(round(l_extendedprice * 100) as bigint)) as amt_c
           from lineitem group by l_suppkey, cast(l_shipdate as date)),
     bar_r as (select *, cast(round(100.0 * (disc - 5 * n) / n) as bigint) as r_bp from bar_d),
     bar_c as (select *, sum(r_bp) over (partition by l_suppkey order by trade_date
                  rows between unbounded preceding and current row) as cum from bar_r),
     bar_p as (select l_suppkey, trade_date, vol, amt_c, round(100 * exp(cum / 10000.0), 4) as close from bar_c),
     bar_o as (select *, coalesce(lag(close) over (partition by l_suppkey order by trade_date), 100.0) as open from bar_p),
     bars as materialized (
       select concat('S', lpad(cast(l_suppkey as varchar), 6, '0')) as ts_code, trade_date, cast(open as double) as open,
              cast(greatest(open, close) * 1.01 as double) as high, cast(least(open, close) * 0.99 as double) as low,
              cast(close as double) as close, cast(vol as double) as vol, cast(amt_c / 100.0 as double) as amount from bar_o)
"""


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def present(df: DataFrame) -> DataFrame:
    """Output form for comparison: dates as text, doubles at 6 decimals."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def oracle(final: str, ctes: str = "", *, dates: str = "", nums: str = "", ints: str = "", bars: bool = True) -> str:
    """SQL in the same output form; ``dates``/``nums``/``ints`` name the columns to convert."""
    head = BARS_SQL if bars else "with one as (select 1 as x)"
    parts = [f"cast({c} as varchar) as {c}" for c in dates.split()]
    parts += [f"round(cast({c} as double), 6) + 0::double as {c}" for c in nums.split()]
    parts += [f"cast({c} as bigint) as {c}" for c in ints.split()]
    # stated once and read often: a table expression that is inlined into joins of bars with bars is planned badly
    ctes = re.sub(r"\b(\w+) as \((?=\s*select\b)", r"\1 as materialized (", ctes)
    middle = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    replace = f" replace ({', '.join(parts)})" if parts else ""
    return f"{head}{middle},\nfinal_rows as ({final.strip()})\nselect *{replace} from final_rows"
