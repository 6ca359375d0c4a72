"""Column checks and selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_ALIASES = {
    "ts_code": ("ts_code", "code", "ticker"),
    "asof_date": ("asof_date", "trade_date", "date"),
    "label": ("label", "y", "target"),
}
NON_FEATURES = ("sample_id", "ts_code", "asof_date", "label", "split", "label_source", "confidence")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available {df.columns}")


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename; missing sources, equal targets and overwriting another column are errors."""
    if not mapping:
        return df
    require_columns(df, mapping)
    targets = list(mapping.values())
    if len(set(targets)) != len(targets):
        raise ValueError(f"two columns would get the same name: {targets}")
    clash = [t for s, t in mapping.items() if t != s and t in df.columns and t not in mapping]
    if clash:
        raise ValueError(f"rename would overwrite columns: {clash}")
    return df.withColumnsRenamed({s: t for s, t in mapping.items() if s != t})


def pick_column(df: DataFrame, candidates: Iterable[str], required: bool = True) -> str | None:
    """First candidate present, ignoring case."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def label_schema(df: DataFrame) -> DataFrame:
    """Rename common label column spellings to ts_code, asof_date, label."""
    found = {pick_column(df, alt): name for name, alt in LABEL_ALIASES.items()}
    return rename_columns(df, found)


def feature_columns(df: DataFrame, exclude: Iterable[str] = (), numeric_only: bool = True) -> list[str]:
    skip = set(NON_FEATURES) | set(exclude)
    return [
        f.name
        for f in df.schema
        if f.name not in skip and (not numeric_only or isinstance(f.dataType, (T.NumericType, T.BooleanType)))
    ]


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once.

    The repeated keys come from a partial aggregate, so a hot key is one row by the time it is shuffled; AQE splits a
    skewed probe side of the semi join.
    """
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(repeated.alias("r"), cond, "left_semi")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    extra = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if extra:
        raise ValueError(f"duplicate keys in {keys}")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Best row per key; the rank filter is pushed below the shuffle (window group limit)."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
