"""Labels from candidates, negative pools, the acceptance rule, and label checks."""

from __future__ import annotations

import bisect
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.cols import lenient_date
from barloom.functions.ordering import take_first
from barloom.functions.rolling import Series, per_entity
from barloom.functions.windows import BARS
from barloom.operators.schema import first_per_key, require_columns
from barloom.operators.selection import hash_order

# fixed values: label columns, carried columns, and the negative sources with their confidence
LABEL_COLUMNS = [
    "sample_id", "ts_code", "asof_date", "label", "label_source", "confidence", "pattern_type", "source_miner",
    "candidate_score", "split",
]
CARRIED_COLUMNS = [
    "miner_name", "pattern_stage", "window", "prior_drawdown_pct", "base_duration_bars", "support_touch_count",
    "neckline_price", "breakout_distance_pct", "breakout_recency_bars", "right_side_duration_bars", "volume_ratio_20",
    "monthly_trend_months", "monthly_trend_return_pct", "monthly_trend_ma_slope_pct", "monthly_close_vs_ma_pct", "rule_flags",
]
NEGATIVE_SOURCES = {"random_non_event": 0.60, "downtrend_continuation": 0.70, "weak_base_non_breakout": 0.65}

_TEXT = {"sample_id", "ts_code", "label_source", "pattern_type", "source_miner", "split", "miner_name", "pattern_stage", "window", "rule_flags"}


def _type(name: str) -> T.DataType:
    if name in _TEXT:
        return T.StringType()
    if name == "asof_date":
        return T.DateType()
    return T.IntegerType() if name == "label" else T.DoubleType()


def finalize(df: DataFrame) -> DataFrame:
    """Fixed columns and types, a missing label as 0, in date, label (desc), code, source order."""
    out = df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(_type(c)).alias(c) for c in LABEL_COLUMNS + CARRIED_COLUMNS]
    ).withColumn("label", F.coalesce("label", F.lit(0)))
    return out.orderBy("asof_date", F.desc("label"), "ts_code", "label_source")


def positive_labels(candidates: DataFrame, pattern: str = "long_base_breakout") -> DataFrame:
    """One positive label per code, date and pattern: the best scored candidate."""
    require_columns(candidates, ["ts_code", "asof_date"])
    score = F.col("candidate_score").try_cast("double") if "candidate_score" in candidates.columns else F.lit(None).cast("double")
    conf = F.col("confidence").try_cast("double") if "confidence" in candidates.columns else F.lit(None).cast("double")
    out = candidates.withColumns(
        {
            "ts_code": F.upper(F.trim("ts_code")),
            "asof_date": lenient_date("asof_date"),
            "candidate_score": score,
            "confidence": F.coalesce(conf, F.lit(0.70)),
            "label": F.lit(1),
            "label_source": F.lit(f"rule_{pattern}"),
            "pattern_type": F.lit(pattern),
            "source_miner": F.lit(pattern),
        }
    ).where("asof_date is not null and ts_code is not null and ts_code <> ''")
    tie = [F.asc(c) for c in ("sample_id",) if c in candidates.columns]
    out = first_per_key(out, ["ts_code", "asof_date", "pattern_type"], [F.desc_nulls_last("candidate_score"), *tie])
    sid = F.concat_ws("_", "ts_code", F.date_format("asof_date", "yyyy-MM-dd"), F.lit(f"{pattern}_pos"))
    out = out.withColumn("sample_id", sid)
    return out.select(
        *[(F.col(c) if c in out.columns else F.lit(None)).cast(_type(c)).alias(c) for c in LABEL_COLUMNS + CARRIED_COLUMNS]
    )


def usable_bars(bars: DataFrame, min_rows: int = 120) -> DataFrame:
    """Clean bars of symbols with enough of them."""
    b = bars.where("trade_date is not null and close is not null").withColumn("ts_code", F.upper(F.trim("ts_code")))
    return b.withColumn("__n", BARS.bars()).where(F.col("__n") >= min_rows).drop("__n")


def _with_frames(bars: DataFrame, names: list[str], frames) -> DataFrame:
    """Bars with their position ``rn`` and frames of the close."""
    return per_entity(bars.select("ts_code", "trade_date", "close", BARS.index().alias("rn")), ["close"], names, frames)


def downtrend_pool(bars: DataFrame) -> DataFrame:
    """Bars in a continuing downtrend, from the 253rd bar on."""
    c = F.col("close")

    def frames(x: dict[str, Series]) -> dict[str, Series]:
        m60 = x["close"].mean(60)
        return {"m60": m60, "m120": x["close"].mean(120), "top60": x["close"].high(60, lag=1), "r120": x["close"].change(120), "m60_back": m60.lag(20)}

    b = _with_frames(bars, ["m60", "m120", "top60", "r120", "m60_back"], frames)
    falling = (F.col("m60") < F.col("m120")) | (F.col("m60") < F.col("m60_back"))
    return b.where((F.col("rn") >= 253) & (c < F.col("m60")) & falling & (F.col("r120") < -0.15) & (c < F.col("top60"))).select(
        "ts_code", F.col("trade_date").alias("asof_date")
    )


def weak_base_pool(bars: DataFrame) -> DataFrame:
    """Bars in a quiet base below resistance, from the 505th bar on."""
    c = F.col("close")

    def frames(x: dict[str, Series]) -> dict[str, Series]:
        close = x["close"]
        return {
            "hi": close.high(252, lag=1),
            "lo": close.low(252, lag=1),
            "sd": close.std(120, sample=True),
            "mu": close.mean(120),
            "h120": close.high(120),
            "l120": close.low(120),
            "res": close.high(120, lag=1),
        }

    b = _with_frames(bars, ["hi", "lo", "sd", "mu", "h120", "l120", "res"], frames)
    quiet = (F.col("sd") / F.col("mu") <= 0.12) | ((F.col("h120") - F.col("l120")) / F.col("mu") <= 0.35)
    keep = (
        (F.col("rn") >= 505)
        & ((F.col("hi") - F.col("lo")) / F.col("hi") >= 0.15)
        & quiet
        & (c <= F.col("res") * 0.97)
        & (c >= F.col("lo") * 1.05)
    )
    return b.where(keep).select("ts_code", F.col("trade_date").alias("asof_date"))


def random_pool(bars: DataFrame) -> DataFrame:
    """Every bar from the 505th on."""
    return bars.withColumn("rn", BARS.index()).where("rn >= 505").select("ts_code", F.col("trade_date").alias("asof_date"))


POOLS = {"random_non_event": random_pool, "downtrend_continuation": downtrend_pool, "weak_base_non_breakout": weak_base_pool}


def split_targets(total: int) -> dict[str, int]:
    """Even split over the sources; the first ones take the remainder."""
    names = list(NEGATIVE_SOURCES)
    base, extra = divmod(total, len(names))
    return {n: base + (1 if i < extra else 0) for i, n in enumerate(names)}


def far_from(pool: DataFrame, positives: DataFrame, days: int) -> DataFrame:
    """Drop rows within ``days`` calendar days of a positive of the same symbol.

    Dates meet in buckets of ``days + 1`` days (a positive covers its own bucket and both neighbours), so no symbol is
    paired with itself as a whole.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    near = positives.select("ts_code", F.col("asof_date").alias("__pd")).distinct()
    near = near.withColumn("__b", F.explode(F.sequence(bucket(F.col("__pd")) - 1, bucket(F.col("__pd")) + 1)))
    left = pool.withColumn("__b", bucket(F.col("asof_date")))
    cond = (F.col("l.ts_code") == F.col("p.ts_code")) & (F.col("l.__b") == F.col("p.__b")) & (F.abs(F.datediff("l.asof_date", "p.__pd")) <= days)
    return left.alias("l").join(near.alias("p"), cond, "left_anti").drop("__b")


def accept(pool: DataFrame, taken: DataFrame, target: int, max_per_symbol: int, min_gap: int, seed: int) -> DataFrame:
    """Rows accepted from a pool in hash order, given the dates taken already.

    A symbol's decisions depend on its own earlier ones only, so the walk is a fold per symbol (at most one row per day)
    and the target is a cut of the accepted rows in the global order.
    """
    h = hash_order(seed, "ts_code", "asof_date")
    queue = pool.groupBy("ts_code").agg(F.sort_array(F.collect_set(F.struct(h.alias("h"), F.unix_date("asof_date").alias("d")))).alias("q"))
    before = taken.groupBy("ts_code").agg(F.collect_list(F.unix_date("asof_date")).alias("t"))
    both = queue.join(before, "ts_code", "left")
    empty = F.expr("cast(array() as array<int>)")
    walks = both.select("ts_code", F.transform("q", lambda x: x["d"]).alias("q"), F.coalesce("t", empty).alias("t"))
    apart = max(min_gap, 1)  # a date is never taken twice

    def walk(queue: list[int], before: list[int]) -> list[int]:
        taken, new = sorted(before), []
        for d in queue:
            if len(taken) >= max_per_symbol:
                break
            i = bisect.bisect_left(taken, d)
            if (i < len(taken) and taken[i] - d < apart) or (i > 0 and d - taken[i - 1] < apart):
                continue
            taken.insert(i, d)
            new.append(d)
        return new

    def run(batches):
        for batch in batches:
            new = [walk(q, t) for q, t in zip(batch.column("q").to_pylist(), batch.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("ts_code"), pa.array(new, pa.list_(pa.int32()))], ["ts_code", "new"])

    new = walks.mapInArrow(run, "ts_code string, new array<int>").select("ts_code", F.explode("new").alias("d"))
    dated = new.select("ts_code", F.date_from_unix_date("d").alias("asof_date")).withColumn("__h", hash_order(seed, "ts_code", "asof_date"))
    return take_first(dated, [F.asc("__h"), F.asc("ts_code"), F.asc("asof_date")], target).drop("__h")


def negative_rows(accepted: DataFrame, source: str) -> DataFrame:
    day = F.date_format("asof_date", "yyyy-MM-dd")
    return accepted.select(
        F.concat_ws("_", "ts_code", day, F.lit(f"{source}_neg")).alias("sample_id"),
        "ts_code",
        "asof_date",
        F.lit(0).alias("label"),
        F.lit(source).alias("label_source"),
        F.lit(NEGATIVE_SOURCES[source]).alias("confidence"),
        F.lit("negative").alias("pattern_type"),
        F.lit("negative_sampler").alias("source_miner"),
        F.lit(0.0).alias("candidate_score"),
    )


def symbol_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ts_code").agg(F.min("trade_date").alias("range_start"), F.max("trade_date").alias("range_end"))


def availability(labels: DataFrame, bars: DataFrame, min_asof_date: str | None = None) -> DataFrame:
    """Labels with ``drop_cause``: bad date, too early, unknown symbol, outside the symbol's dates; NULL keeps."""
    df = labels.withColumns({"ts_code": F.upper(F.trim("ts_code")), "asof_date": lenient_date("asof_date")})
    df = df.join(symbol_ranges(bars), "ts_code", "left")
    early = F.col("asof_date") < F.lit(min_asof_date).cast("date") if min_asof_date else F.lit(False)
    cause = (
        F.when(F.col("asof_date").isNull(), "invalid_date")
        .when(early, "before_min_date")
        .when(F.col("range_start").isNull(), "missing_symbol")
        .when(~F.col("asof_date").between(F.col("range_start"), F.col("range_end")), "outside_symbol_range")
    )
    return df.withColumn("drop_cause", cause).drop("range_start", "range_end")


def available(labels: DataFrame, bars: DataFrame, min_asof_date: str | None = None) -> DataFrame:
    return availability(labels, bars, min_asof_date).where("drop_cause is null").drop("drop_cause")


def validate_ranges(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Labels outside the global and the symbol's own dates, and labels of unknown symbols, as one row."""
    whole = symbol_ranges(bars)
    span = whole.agg(F.min("range_start").alias("daily_min"), F.max("range_end").alias("daily_max"))
    df = labels.join(whole, "ts_code", "left").join(F.broadcast(span))  # one-row side
    d = F.col("asof_date")
    known = F.col("range_start").isNotNull()
    return df.agg(
        F.min("daily_min").alias("daily_min"),
        F.max("daily_max").alias("daily_max"),
        F.min(d).alias("labels_min"),
        F.max(d).alias("labels_max"),
        F.count_if((d < F.col("daily_min")) | (d > F.col("daily_max"))).alias("outside_global"),
        F.count_if(~known & d.isNotNull()).alias("missing_symbol"),
        F.count_if(d.isNull() | (known & ~d.between(F.col("range_start"), F.col("range_end")))).alias("outside_symbol"),
    )


def distinct_labels(parts: list[DataFrame]) -> DataFrame:
    """Union by name; the first part wins on code, date, pattern and source."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_per_key(both, ["ts_code", "asof_date", "pattern_type", "label_source"], [F.asc("__part"), F.asc("sample_id")]).drop("__part")
