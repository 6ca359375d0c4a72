"""Normalisation of daily bars from different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cols import instrument_id, lenient_date, ratio
from barloom.functions.windows import BARS
from barloom.operators.schema import pick_column, require_columns
from barloom.sources.bars import one_row_per_day

# fixed column sets
CN_COLUMNS = [
    "trade_date", "open", "high", "low", "close", "vol", "amount", "pct_chg", "ma_bfq_20", "ma_bfq_60", "ma_bfq_250",
    "cost_5pct", "cost_15pct", "cost_50pct", "cost_85pct", "cost_95pct", "weight_avg", "winner_rate",
]
CN_TEXT_COLUMNS = ["ts_code", "trade_date", "symbol", "name", "area", "industry", "market", "list_date"]
US_PRICE_COLUMNS = [
    "instrument_id", "symbol", "market", "trade_date", "open", "high", "low", "close", "volume", "adj_close",
    "dividends", "stock_splits", "source", "created_at",
]
INSTRUMENT_COLUMNS = [
    "instrument_id", "symbol", "market", "exchange", "name", "asset_type", "sector", "industry", "currency",
    "is_active", "list_date", "delist_date", "source", "updated_at",
]
ACTION_COLUMNS = ["instrument_id", "symbol", "market", "action_date", "action_type", "value", "source", "created_at"]
_TEXT_TYPES = {"market": "string", "source": "string", "created_at": "timestamp", "instrument_id": "string"}


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def infer_code(df: DataFrame, file_column: str = "entity_file") -> Column:
    """Entity code of a row: ts_code, else symbol, else the file stem."""
    found = [c for c in ("ts_code", "symbol", file_column) if c in df.columns]
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in found])


def daily_bars(df: DataFrame, order: Column | str, optional: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Common daily form: code inferred, volume under one name, lenient types, last row wins per date."""
    require_columns(df, ["trade_date", "close"])
    vol = pick_column(df, ["vol", "volume"], required=False)
    named = {
        "ts_code": infer_code(df),
        "trade_date": lenient_date("trade_date"),
        **{c: number(c) if c in df.columns else F.lit(None).cast("double") for c in ("open", "high", "low", "close")},
        "vol": number(vol) if vol else F.lit(None).cast("double"),
        **{c: number(c) for c in optional if c in df.columns},
    }
    order = F.col(order) if isinstance(order, str) else order
    picked = df.select(*[c.alias(n) for n, c in named.items()], order.alias("__ord"))
    return one_row_per_day(picked.where("trade_date is not null"), "__ord").drop("__ord")


def training_bars(df: DataFrame, order: Column | str) -> DataFrame:
    """Bars for training: OHLC required, volume from vol, else volume, else 0; non-positive closes dropped."""
    require_columns(df, ["trade_date", "open", "high", "low", "close"])
    vols = [number(c) for c in ("vol", "volume") if c in df.columns]
    order = F.col(order) if isinstance(order, str) else order
    out = df.select(
        F.upper(F.col("ts_code")).alias("ts_code"),
        lenient_date("trade_date").alias("trade_date"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(*vols, F.lit(0.0)).alias("vol"),
        order.alias("__ord"),
    )
    out = out.dropna(subset=["trade_date", "open", "high", "low", "close"]).where("close > 0")
    return one_row_per_day(out, "__ord").drop("__ord")


def daily_with_units(
    df: DataFrame,
    order: Column | str | None = None,
    *,
    vol_unit: str = "lots",
    amount_unit: str = "thousand_yuan",
    duplicates: str = "raise",
    derive: bool = False,
) -> DataFrame:
    """Daily bars in shares and yuan.  Duplicates raise (checked with one aggregate), or keep the first or last row."""
    require_columns(df, ["trade_date"])
    cols = [c for c in ("open", "high", "low", "close", "vol", "amount", "pct_chg") if c in df.columns]
    scale = {
        "vol": 100.0 if vol_unit == "lots" else 1.0,
        "amount": 1000.0 if amount_unit == "thousand_yuan" else 1.0,
    }
    if duplicates != "raise" and order is None:
        raise ValueError("keeping the first or last of repeated rows needs an order")
    order = F.lit(0) if order is None else (F.col(order) if isinstance(order, str) else order)
    out = df.select(
        "ts_code",
        lenient_date("trade_date").alias("trade_date"),
        *[(number(c) * F.lit(scale.get(c, 1.0))).alias(c) for c in cols],
        order.alias("__ord"),
    ).where("trade_date is not null")
    if duplicates == "raise":
        repeated = out.groupBy("ts_code", "trade_date").count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"duplicate trade_date: {[(r.ts_code, str(r.trade_date)) for r in repeated]}")
        out = out.drop("__ord")
    else:
        out = one_row_per_day(out, "__ord", keep=duplicates).drop("__ord")
    if derive and "close" in cols:
        pre = BARS.lag("close")
        out = out.withColumns(
            {"pre_close": pre, "change": F.col("close") - pre, "pct_chg_calc": ratio(F.col("close") - pre, pre) * 100.0}
        )
    return out


def cn_flat(df: DataFrame, order: Column | str) -> DataFrame:
    """Flat multi-symbol increment: trimmed codes, yyyyMMdd dates, numbers where not text, last row per key."""
    require_columns(df, ["ts_code", "trade_date"])
    text = F.replace(F.trim(F.col("trade_date").cast("string")), F.lit("-"), F.lit(""))
    order = F.col(order) if isinstance(order, str) else order
    keep = [c for c in df.columns if c != "__ord"]
    out = df.select(
        *[
            F.trim("ts_code").alias(c)
            if c == "ts_code"
            else F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date").alias(c)
            if c == "trade_date"
            else F.col(c)
            if c in CN_TEXT_COLUMNS
            else number(c).alias(c)
            for c in keep
        ],
        order.alias("__ord"),
    )
    return one_row_per_day(out, "__ord").drop("__ord")


def cn_symbol(df: DataFrame) -> DataFrame:
    """Per-symbol table: valid dates only, every other column numeric."""
    require_columns(df, ["trade_date"])
    return df.select(
        *[
            lenient_date(c).alias(c) if c == "trade_date" else F.col(c) if c == "ts_code" else number(c).alias(c)
            for c in df.columns
        ]
    ).where("trade_date is not null")


def increment_rows(df: DataFrame, order: Column | str, columns: list[str] = CN_COLUMNS) -> DataFrame:
    """Rows of an increment in the fixed column order, keyed by symbol; bad dates dropped."""
    flat = cn_flat(df, order)
    return flat.select("ts_code", *[c for c in columns if c in flat.columns]).where("trade_date is not null")


def us_prices(df: DataFrame) -> DataFrame:
    """The 14 price columns in order; absent ones are NULL."""
    out = []
    for c in US_PRICE_COLUMNS:
        if c == "trade_date":
            out.append(lenient_date(c).alias(c))
        elif c in df.columns:
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast(_TEXT_TYPES.get(c, "double")).alias(c))
    return df.select(*out)


def instruments(universe: DataFrame, market: str = "US", source: str = "universe") -> DataFrame:
    """One row per universe symbol with default market, type, currency and activity."""
    defaults = {
        "market": F.lit(market), "asset_type": F.lit("equity"), "currency": F.lit("USD"), "is_active": F.lit(True),
        "source": F.lit(source), "updated_at": F.current_timestamp(),
    }
    types = {"list_date": "date", "delist_date": "date"}
    symbol = F.upper(F.col("symbol"))
    base = universe.withColumn("symbol", symbol)
    out = []
    for c in INSTRUMENT_COLUMNS:
        if c == "instrument_id":
            out.append(instrument_id(F.lit(market), "symbol").alias(c))
        elif c in base.columns:
            out.append(F.col(c))
        else:
            out.append(defaults.get(c, F.lit(None).cast(types.get(c, "string"))).alias(c))
    return base.select(*out)
