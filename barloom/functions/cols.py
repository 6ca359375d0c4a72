"""Null-safe column helpers shared by every operator.

Missing values are NULL, never NaN.  A comparison with a missing side counts as False, and a division by zero gives
NULL instead of raising (ANSI) or giving infinity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(cond: Column) -> Column:
    """Boolean with unknown treated as False."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """0/1 integer with unknown treated as 0."""
    return holds(cond).cast("int")


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def change(num: Column, den: Column) -> Column:
    return F.try_divide(num, den) - F.lit(1.0)


def safe_ratio(num: Column, den: Column, eps: float = EPS) -> Column:
    """Quotient, NULL when the denominator is missing or within ``eps`` of zero."""
    return F.when(F.abs(den) > F.lit(eps), num / den)


def safe_change(num: Column, den: Column, eps: float = EPS) -> Column:
    return safe_ratio(num, den, eps) - F.lit(1.0)


def positive_change(now: Column, before: Column) -> Column:
    """Relative change, NULL unless the earlier value is positive."""
    return F.when(before > 0, now / before - F.lit(1.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def non_zero(value: Column) -> Column:
    return F.when(value != 0, value)


def _logistic(exponent: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(clamp(exponent, -60.0, 60.0)))


def sigmoid_decay(value: Column, threshold: float, sharpness: float, missing: float = 1.0) -> Column:
    v = value.cast("double")
    return F.coalesce(F.when(v.isNotNull(), _logistic((v - threshold) * sharpness)), F.lit(float(missing)))


def sigmoid_rise(value: Column, threshold: float, sharpness: float, missing: float = 0.0) -> Column:
    v = value.cast("double")
    return F.coalesce(F.when(v.isNotNull(), _logistic((v - threshold) * -sharpness)), F.lit(float(missing)))


def sigmoid_boost(value: Column, threshold: float, sharpness: float, max_boost: float, missing: float = 1.0) -> Column:
    v = value.cast("double")
    rise = F.when(v.isNotNull(), F.lit(1.0) + F.lit(float(max_boost)) * _logistic((v - threshold) * -sharpness))
    return F.coalesce(rise, F.lit(float(missing)))


def toward_neutral(factor: Column, weight: float) -> Column:
    """Blend a multiplicative factor with the neutral 1.0.

    With full weight the factor is left as it is: the way over 1.0 would turn every factor below 1e-16 into 0.
    """
    if float(weight) == 1.0:
        return factor.cast("double")
    return F.lit(1.0) + F.lit(float(weight)) * (factor - F.lit(1.0))


def scale_factor(raw: Column, low: float, high: float) -> Column:
    """Map a 0..1 score linearly to ``low..high``."""
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * F.when(raw.isNotNull(), clamp(raw))


def interpolate(value: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    if x1 <= x0:
        return F.lit(float(y1))
    share = (clamp(value, x0, x1) - F.lit(x0)) / F.lit(x1 - x0)
    return F.lit(float(y0)) + share * F.lit(float(y1 - y0))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Clamped weighted average of sub-scores, rounded to 6 decimals; 0 when no weight is left."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return F.lit(0.0)
    weighted = reduce(lambda a, b: a + b, [p * F.lit(float(w)) for p, w in parts])
    return F.round(clamp(weighted / F.lit(float(total))), 6)


def flags_text(parts: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in the given order, joined by ';'."""
    return F.concat_ws(";", *[F.when(holds(cond), F.lit(name)) for cond, name in parts])


def number_flag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string(name + "=%.3f", value))


def instrument_id(market: Column | str, symbol: Column | str) -> Column:
    return F.concat_ws(":", F.upper(col(market)), F.upper(col(symbol)))


def sample_id(code: Column | str, asof: Column | str) -> Column:
    return F.concat_ws("_", col(code), F.date_format(col(asof), "yyyy-MM-dd"))


def lenient_date(value: Column | str) -> Column:
    """Date or NULL; accepts dates, yyyy-MM-dd and yyyyMMdd text."""
    text = F.trim(col(value).cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyyMMdd")),
        F.try_to_timestamp(text),
    ).cast("date")


def date_text(value: Column | str) -> Column:
    return F.coalesce(F.date_format(col(value), "yyyy-MM-dd"), F.lit(""))


def compact_date(value: Column | str) -> Column:
    return F.replace(col(value).cast("string"), F.lit("-"), F.lit(""))


def safe_name(value: Column | str) -> Column:
    """File-system-safe name: other characters become '_', outer '.' and '_' go, empty becomes UNKNOWN."""
    cleaned = F.regexp_replace(F.trim(col(value)), r"[^A-Za-z0-9._-]+", "_")
    stripped = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(F.length(stripped) > 0, stripped).otherwise(F.lit("UNKNOWN"))


def split_ratio(numerator: Column, denominator: Column, text: Column) -> Column:
    """Split ratio from explicit parts, else from 'a:b' text, else 0."""
    parts = F.split(text, ":")
    from_text = F.try_divide(parts.getItem(0).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    explicit = F.when(denominator != 0, F.try_divide(numerator, denominator))
    return F.coalesce(explicit, F.when(F.instr(text, ":") > 0, from_text), F.lit(0.0))


def limit_like(code: Column | str, pct_chg: Column | str) -> Column:
    """Limit-up day: 19 percent on the growth boards (codes 300 and 688), 9.5 elsewhere."""
    c = col(code)
    wide = c.startswith("300") | c.startswith("688")
    return holds(col(pct_chg) >= F.when(wide, F.lit(19.0)).otherwise(F.lit(9.5)))
