"""Mining jobs over all entities: registry of miners, run job, and user miners."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.ordering import take_first
from barloom.operators import bases
from barloom.operators.miners import CANDIDATE_SCHEMA, THRESHOLD_MINERS, candidate_order, complete_schema, scan_thresholds
from barloom.operators.pullback import Pullback, pullback_negatives, pullback_samples
from barloom.operators.selection import symbols_filter, top_per_group
from barloom.session import stored

OTHER_MINERS: dict[str, tuple[Callable, Callable]] = {
    "w_bottom": (bases.WBottom.from_dict, bases.w_bottom),
    "bottom_base_breakout": (bases.BottomBase.from_dict, bases.bottom_base_breakout),
    "long_base_breakout": (bases.LongBase.from_dict, bases.long_base_breakout),
    "pullback_pattern": (Pullback.from_dict, pullback_samples),
    "pullback_negative": (Pullback.from_dict, pullback_negatives),
}


def miner_names() -> list[str]:
    return sorted([*THRESHOLD_MINERS, *OTHER_MINERS])


def miner_config(name: str, data: dict | None):
    """Config from a block named like the miner, or from the top level; unknown keys are ignored."""
    data = data or {}
    block = data.get(name, data)
    if name in THRESHOLD_MINERS:
        return THRESHOLD_MINERS[name][0].from_dict(block)
    if name in OTHER_MINERS:
        return OTHER_MINERS[name][0](block)
    raise ValueError(f"unknown miner: {name}; known: {miner_names()}")


def mine(bars: DataFrame, name: str, config: dict | None = None, **mode) -> DataFrame:
    cfg = miner_config(name, config)
    if name in THRESHOLD_MINERS:
        return scan_thresholds(bars, {name: cfg})
    return OTHER_MINERS[name][1](bars, cfg, **mode)


def mine_many(
    bars: DataFrame,
    configs: dict[str, dict],
    symbols: str | list[str] | None = None,
    max_total: int = 0,
    per_miner_total: bool = False,
) -> DataFrame:
    """Run several miners as one candidate table in global order.

    Threshold miners share one pass.  ``per_miner_total`` applies each miner's ``max_candidates_total``; with one miner
    that is the same as a global cap.
    """
    bars = symbols_filter(bars, symbols)
    cfgs = {n: miner_config(n, c) for n, c in configs.items()}
    simple = {n: c for n, c in cfgs.items() if n in THRESHOLD_MINERS}
    parts = [scan_thresholds(bars, simple)] if simple else []
    parts += [complete_schema(OTHER_MINERS[n][1](bars, c)) for n, c in cfgs.items() if n not in THRESHOLD_MINERS]
    out = reduce(DataFrame.unionByName, parts)
    if per_miner_total:
        caps = {n: getattr(c, "max_candidates_total", 0) for n, c in cfgs.items()}
        caps = {n: k for n, k in caps.items() if k}
        if caps:
            capped = out.where(F.col("miner_name").isin(list(caps)))
            capped = top_per_group(capped, ["miner_name"], candidate_order(), max(caps.values()), "__g")
            own = reduce(lambda a, b: a | b, [(F.col("miner_name") == n) & (F.col("__g") <= k) for n, k in caps.items()])
            out = capped.where(own).drop("__g").unionByName(out.where(~F.col("miner_name").isin(list(caps))))
    if max_total:
        return take_first(out, candidate_order(), max_total)
    return out


def write_candidates(candidates: DataFrame, path: str) -> None:
    candidates.orderBy(*candidate_order()).write.mode("overwrite").option("header", True).csv(path)


@dataclass
class MinerRun:
    """Rows that a miner found, and the entities it failed on with the reason."""

    rows: DataFrame
    failures: DataFrame

    def accounts(self, bars: DataFrame) -> DataFrame:
        """One row: entities scanned, entities failed and rows found."""
        failed = self.failures.agg(F.count(F.lit(1)).alias("failed_symbols"))
        found = self.rows.agg(F.count(F.lit(1)).alias("candidates"))
        return bars.agg(F.count_distinct("ts_code").alias("symbol_count")).join(failed).join(found)  # one-row sides


Scan = Callable[[str, pd.DataFrame], pd.DataFrame]
_ERROR = "__error"


def _user_rows(bars: DataFrame, scan_one: Scan, schema: T.StructType, collect: bool) -> DataFrame:
    names = [f.name for f in schema]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = scan_one(key[0], pdf.sort_values("trade_date").reset_index(drop=True)).reindex(columns=names)
            return out.assign(**{_ERROR: None, "__code": key[0]}) if collect else out
        except Exception as e:  # noqa: BLE001 - what a user's function raises is the result here
            if not collect:
                raise
            return pd.DataFrame({**{n: pd.Series([None], dtype=object) for n in names}, _ERROR: [f"{type(e).__name__}: {e}"], "__code": [key[0]]})

    extra = [T.StructField(_ERROR, T.StringType()), T.StructField("__code", T.StringType())] if collect else []
    return bars.groupBy("ts_code").applyInPandas(run, T.StructType([*schema.fields, *extra]))


def user_miner(bars: DataFrame, scan_one: Scan, schema: T.StructType = CANDIDATE_SCHEMA) -> DataFrame:
    """Run a user's per-entity function over all entities; it sees one entity's days in order.  An error stops the job."""
    return _user_rows(bars, scan_one, schema, False)


def run_user_miner(bars: DataFrame, scan_one: Scan, schema: T.StructType = CANDIDATE_SCHEMA) -> MinerRun:
    """As ``user_miner``, but an entity whose scan fails becomes a row (ts_code, reason) and the others go on.

    Both tables come from one pass, which is stored.
    """
    both = stored(_user_rows(bars, scan_one, schema, True))
    failed = F.col(_ERROR).isNotNull()
    return MinerRun(both.where(~failed).drop(_ERROR, "__code"), both.where(failed).select(F.col("__code").alias("ts_code"), F.col(_ERROR).alias("reason")))
