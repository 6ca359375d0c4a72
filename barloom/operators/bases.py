"""Base-shape miners: double bottom, bottom-base breakout and long-base breakout.

Cheap window columns select the bars worth a closer look.  Each survivor then gets the bars of its own window as one
array, whose length is the largest lookback (a parameter, never the data volume), and is judged with array functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.cols import clamp, flags_text, holds, number_flag, positive_change, ratio, weighted_mean
from barloom.functions.windows import BARS
from barloom.operators.schema import first_per_key
from barloom.operators.selection import spaced_selection, top_per_group


@dataclass(frozen=True)
class Lookback:
    name: str
    bars: int


@dataclass(frozen=True)
class ScanRows:
    mode: str = "historical"
    asof_stride: int = 5
    min_asof_date: str | None = "2016-01-01"
    max_asof_date: str | None = None
    max_candidates_per_symbol: int = 50
    min_days_between_candidates: int = 20


def _known(cls, data: dict | None) -> dict:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in (data or {}).items() if k in names}


def step(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a one-row generator, so later filters do not copy their expressions below it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars with complete positive prices, their position, and the current-bar metrics the candidates carry."""
    cols = ["ts_code", "trade_date", "open", "high", "low", "close"]
    vol = F.coalesce(F.col("vol"), F.lit(0.0)) if "vol" in bars.columns else F.lit(0.0)
    b = bars.select(*cols, vol.alias("vol")).dropna(subset=cols[1:]).where("close > 0")
    return b.withColumns({"rn": BARS.index(), "n_bars": BARS.bars()})


def with_now(bars: DataFrame, ma_window: int = 20, volume: bool = True) -> DataFrame:
    base = BARS.mean("vol", ma_window)
    vr = F.coalesce(F.when(base > 0, F.col("vol") / base), F.lit(0.0)) if volume else F.lit(0.0)
    return bars.withColumns(
        {
            "volume_ratio_20": vr,
            "ret_1d": positive_change(F.col("close"), BARS.lag("close", 1)),
            "ret_3d": positive_change(F.col("close"), BARS.lag("close", 3)),
        }
    )


def scan_rows(bars: DataFrame, max_lookback: int, cfg: ScanRows) -> DataFrame:
    """Bars to evaluate: the last one, or every stride-th bar with full history inside the date range."""
    if cfg.mode not in ("latest", "historical"):
        raise ValueError(f"unsupported scan mode: {cfg.mode}")
    if "rn" not in bars.columns:
        bars = bars.withColumns({"rn": BARS.index(), "n_bars": BARS.bars()})
    if cfg.mode == "latest":
        return bars.where((F.col("rn") == F.col("n_bars")) & (F.col("rn") >= max_lookback))
    out = bars.where((F.col("rn") >= max_lookback) & ((F.col("rn") - max_lookback) % max(1, cfg.asof_stride) == 0))
    if cfg.min_asof_date:
        out = out.where(F.col("trade_date") >= F.lit(cfg.min_asof_date).cast("date"))
    if cfg.max_asof_date:
        out = out.where(F.col("trade_date") <= F.lit(cfg.max_asof_date).cast("date"))
    return out


def attach_windows(rows: DataFrame, bars: DataFrame, size: int) -> DataFrame:
    """Give each row the ``size`` bars that end at its position, as array ``w`` in time order.

    Rows and bars meet on (entity, block of ``size`` bars), at most two blocks per row.
    """
    first = F.col("rn") - size + 1
    blocks = F.array_distinct(F.array(F.floor((F.greatest(first, F.lit(1)) - 1) / size), F.floor((F.col("rn") - 1) / size)))
    left = rows.withColumn("__b", F.explode(blocks))
    right = bars.select(
        "ts_code",
        F.floor((F.col("rn") - 1) / size).alias("__b"),
        F.struct(
            F.col("rn").alias("i"), F.col("trade_date").alias("d"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c")
        ).alias("__bar"),
    )
    joined = left.join(right, ["ts_code", "__b"]).where((F.col("__bar.i") >= first) & (F.col("__bar.i") <= F.col("rn")))
    keep = [c for c in rows.columns if c not in ("ts_code", "rn")]
    packed = joined.groupBy("ts_code", "rn").agg(*[F.first(c).alias(c) for c in keep], F.sort_array(F.collect_list("__bar")).alias("w"))
    return packed


def _first_max(arr: Column, f: str) -> Column:
    """Struct (v, i) of the first largest element."""
    m = F.array_max(F.transform(arr, lambda x: F.struct(x[f].alias("v"), (-x["i"]).alias("n"))))
    return F.struct(m["v"].alias("v"), (-m["n"]).alias("i"))


def _first_min(arr: Column, f: str) -> Column:
    return F.array_min(F.transform(arr, lambda x: F.struct(x[f].alias("v"), x["i"].alias("i"))))


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def _std_over_mean(arr: Column, mean: Column) -> Column:
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(arr)
    return F.when(mean > 0, F.sqrt(var) / mean).otherwise(F.lit(999.0))


def array_quantile(values: Column, p: float) -> Column:
    """Linear quantile of a non-empty array."""
    s = F.array_sort(values)
    pos = F.lit(p) * (F.size(values) - 1)
    lo = F.get(s, F.floor(pos).cast("int"))
    hi = F.get(s, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def separated_touches(touches: Column, min_gap: int) -> Column:
    """Left-to-right choice of touches at least ``min_gap`` bars apart."""
    return F.aggregate(
        touches,
        F.slice(touches, 1, 0),
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x["i"] - F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(x)), -1)["i"] >= min_gap),
            F.concat(acc, F.array(x)),
        ).otherwise(acc),
    )


def first_crossing(w: Column, after: Column, threshold: Column) -> Column:
    """Position of the first bar after ``after`` that closes above the threshold from at or below it."""
    prev = lambda k: F.get(w, (k - 1).cast("int"))["c"]
    hit = F.filter(
        w, lambda x, k: (x["i"] > after) & (x["c"] > threshold) & (prev(k).isNull() | (prev(k) <= threshold))
    )
    return F.get(hit, F.lit(0))["i"]


# ---------------------------------------------------------------- double bottom


@dataclass(frozen=True)
class WBottom:
    label: int = 1
    label_source: str = "rule_w_bottom"
    confidence: float = 0.60
    windows: tuple[Lookback, ...] = (Lookback("short", 120), Lookback("medium", 252), Lookback("long", 504))
    min_prior_drawdown_pct: float = 0.20
    min_middle_rebound_pct: float = 0.08
    max_bottom_price_diff_pct: float = 0.12
    max_right_bottom_break_pct: float = 0.10
    min_bottom_separation_days: int = 20
    max_bottom_separation_days: int = 300
    min_days_after_right_bottom: int = 5
    forming_neckline_distance_pct: float = 0.08
    breakout_neckline_buffer_pct: float = 0.0
    extrema_order: int = 5
    volume_enable: bool = True
    ma_window: int = 20
    breakout_volume_ratio: float = 1.20
    weights: tuple[float, float, float, float, float] = (0.20, 0.25, 0.20, 0.25, 0.10)
    max_candidates_per_symbol: int = 20

    @classmethod
    def from_dict(cls, data: dict | None) -> "WBottom":
        return cls(**_flatten(cls, data))


def _flatten(cls, data: dict | None) -> dict:
    """Config blocks (rules, scan, volume, label, output) merged into flat field names; unknown keys ignored."""
    data = dict(data or {})
    flat = dict(data)
    for block in ("rules", "scan", "label", "output", "volume"):
        value = data.get(block)
        if isinstance(value, dict):
            flat.pop(block, None)
            flat.update({("volume_enable" if (block, k) == ("volume", "enable") else k): v for k, v in value.items()})
    out = _known(cls, flat)
    if isinstance(data.get("windows"), list):
        ws = [Lookback(str(w.get("name", f"window_{i}")), int(w["lookback"])) for i, w in enumerate(data["windows"]) if int(w.get("lookback", 0)) > 0]
        out.pop("windows", None)
        if ws:
            out["windows"] = tuple(ws)
    if isinstance(out.get("scan"), dict):
        out.pop("scan")
    scan_fields = _known(ScanRows, flat)
    if "scan" in {f.name for f in fields(cls)} and scan_fields:
        out["scan"] = replace(cls().scan, **scan_fields)
    return {k: v for k, v in out.items() if k in {f.name for f in fields(cls)}}


def w_bottom(bars: DataFrame, cfg: WBottom = WBottom()) -> DataFrame:
    """Double bottoms that are forming or breaking out at each symbol's last bar, best per window and stage."""
    k = cfg.extrema_order
    size = max(w.bars for w in cfg.windows)
    b = with_now(clean_bars(bars), cfg.ma_window, cfg.volume_enable)
    last = b.where("rn = n_bars").select(
        "ts_code", F.col("trade_date").alias("asof_date"), "n_bars", F.col("close").alias("now"), "volume_ratio_20", "ret_1d", "ret_3d"
    )
    marks = b.withColumns(
        {
            "is_low": F.col("close") == F.min("close").over(BARS.rows(-k, k)),
            "is_high": F.col("close") == F.max("close").over(BARS.rows(-k, k)),
        }
    ).where(F.col("rn") > F.col("n_bars") - size)
    bar = F.struct(F.col("rn").alias("i"), F.col("trade_date").alias("d"), F.col("close").alias("c"), F.col("is_low").alias("lo"), F.col("is_high").alias("hi"))
    arrays = marks.groupBy("ts_code").agg(F.sort_array(F.collect_list(bar)).alias("tail"))
    rows = arrays.join(last, "ts_code")
    choices = F.array(
        *[F.when(F.col("n_bars") >= w.bars, F.struct(F.lit(w.name).alias("window"), F.lit(w.bars).alias("len"), F.lit(o).alias("w_ord"))) for o, w in enumerate(cfg.windows)]
    )
    rows = rows.select("*", F.inline(F.array_compact(choices)))
    rows = step(rows, w=F.slice("tail", F.size("tail") - F.col("len") + 1, F.col("len"))).drop("tail")
    start = F.col("n_bars") - F.col("len")  # bars before the window
    inner = lambda x: (x["i"] > start + k) & (x["i"] <= F.col("n_bars") - k)
    rows = step(
        rows,
        lows=F.filter("w", lambda x: x["lo"] & inner(x)),
        highs=F.filter("w", lambda x: x["hi"] & inner(x)),
    )
    rows = rows.select("*", F.explode("lows").alias("l1"))
    rows = step(rows, h=_first_max(F.slice("w", 1, (F.col("l1.i") - start - 1).cast("int")), "c"))
    rows = step(rows, prior_drawdown_pct=(F.col("h.v") - F.col("l1.c")) / F.col("h.v")).where(
        F.col("prior_drawdown_pct") >= cfg.min_prior_drawdown_pct
    )
    l1 = F.col("l1")
    second = F.filter(
        "lows",
        lambda x: (x["i"] - l1["i"] >= cfg.min_bottom_separation_days)
        & (x["i"] - l1["i"] <= cfg.max_bottom_separation_days)
        & (x["i"] > l1["i"] + 1)
        & (x["i"] <= F.col("n_bars") - cfg.min_days_after_right_bottom)
        & (F.abs(x["c"] / l1["c"] - 1.0) <= cfg.max_bottom_price_diff_pct)
        & (x["c"] >= l1["c"] * (1.0 - cfg.max_right_bottom_break_pct)),
    )
    rows = rows.select("*", F.explode(second).alias("l2"))
    between = lambda x: (x["i"] > F.col("l1.i")) & (x["i"] < F.col("l2.i"))
    peaks = F.filter("highs", between)
    rows = step(rows, m=F.when(F.size(peaks) > 0, _first_max(peaks, "c")).otherwise(_first_max(F.filter("w", between), "c")))
    rows = step(
        rows,
        bottom_similarity_pct=F.abs(F.col("l2.c") / F.col("l1.c") - 1.0),
        middle_rebound_pct=(F.col("m.v") - F.col("l1.c")) / F.col("l1.c"),
        neckline_distance_pct=(F.col("m.v") - F.col("now")) / F.col("m.v"),
        breakout_flag=F.col("now") >= F.col("m.v") * (1.0 + cfg.breakout_neckline_buffer_pct),
    )
    forming = F.col("now") >= F.col("m.v") * (1.0 - cfg.forming_neckline_distance_pct)
    rows = rows.where((F.col("middle_rebound_pct") >= cfg.min_middle_rebound_pct) & (F.col("breakout_flag") | forming))
    vol_ok = F.col("breakout_flag") & (F.col("volume_ratio_20") >= cfg.breakout_volume_ratio) & F.lit(cfg.volume_enable)
    wp, wb, wr, wn, wv = cfg.weights
    near = F.when(F.col("breakout_flag"), F.lit(1.0)).otherwise(
        clamp(F.lit(1.0) - F.greatest(F.col("neckline_distance_pct"), F.lit(0.0)) / max(cfg.forming_neckline_distance_pct, 1e-9))
    )
    score = weighted_mean(
        [
            (clamp(F.col("prior_drawdown_pct") / max(cfg.min_prior_drawdown_pct * 2, 1e-9)), wp),
            (clamp(F.lit(1.0) - F.col("bottom_similarity_pct") / max(cfg.max_bottom_price_diff_pct, 1e-9)), wb),
            (clamp(F.col("middle_rebound_pct") / max(cfg.min_middle_rebound_pct * 2, 1e-9)), wr),
            (near, wn),
            (vol_ok.cast("double"), wv if cfg.volume_enable else 0.0),
        ]
    )
    rows = step(
        rows,
        pattern_stage=F.when(F.col("breakout_flag"), "w_bottom_breakout").otherwise("w_bottom_forming"),
        candidate_score=score,
        low_price=F.least(F.col("l1.c"), F.col("l2.c")),
    )
    best = first_per_key(
        rows, ["ts_code", "window", "pattern_stage"], [F.desc("candidate_score"), F.asc("l1.i"), F.asc("l2.i")]
    )
    day = lambda i: F.get(F.col("w"), (i - start - 1).cast("int"))["d"]
    sid = F.concat_ws("_", "ts_code", F.date_format("asof_date", "yyyy-MM-dd"), F.lit("w_bottom"), "window", "pattern_stage")
    flags = F.concat_ws(
        ";",
        F.lit("prior_drawdown_ok;bottom_similarity_ok;middle_rebound_ok;neckline_ok"),
        "pattern_stage",
        number_flag("prior_drawdown", F.col("prior_drawdown_pct")),
        number_flag("bottom_similarity", F.col("bottom_similarity_pct")),
        number_flag("middle_rebound", F.col("middle_rebound_pct")),
        number_flag("neckline_distance", F.col("neckline_distance_pct")),
        number_flag("volume_ratio_20", F.col("volume_ratio_20")),
        F.when(vol_ok, "volume_breakout_ok"),
    )
    out = best.select(
        sid.alias("sample_id"),
        "ts_code",
        "asof_date",
        F.lit(cfg.label).alias("label"),
        F.lit(cfg.label_source).alias("label_source"),
        F.lit(cfg.confidence).alias("confidence"),
        sid.alias("event_id"),
        F.lit("w_bottom").alias("miner_name"),
        "candidate_score",
        F.col("now").alias("close"),
        # short-term changes must stay inside the window
        "ret_1d",
        "ret_3d",
        F.col("volume_ratio_20").alias("vol_ratio_1d"),
        F.col("len").alias("base_window_days"),
        ((F.col("h.v") - F.col("low_price")) / F.col("low_price")).alias("base_range_pct"),
        "breakout_flag",
        flags.alias("rule_flags"),
        "window",
        "pattern_stage",
        F.col("l1.d").alias("left_bottom_date"),
        F.col("l1.c").alias("left_bottom_price"),
        day(F.col("m.i")).alias("middle_peak_date"),
        F.col("m.v").alias("neckline_price"),
        F.col("l2.d").alias("right_bottom_date"),
        F.col("l2.c").alias("right_bottom_price"),
        day(F.col("h.i")).alias("prior_high_date"),
        F.col("h.v").alias("prior_high_price"),
        "bottom_similarity_pct",
        "middle_rebound_pct",
        "prior_drawdown_pct",
        "neckline_distance_pct",
        "volume_ratio_20",
    )
    order = [F.desc("candidate_score"), F.desc("asof_date"), F.asc("sample_id")]
    return top_per_group(out, ["ts_code"], order, cfg.max_candidates_per_symbol)


# ---------------------------------------------------------------- shared survivor stage


def survivors(bars: DataFrame, cfg, neck: dict[str, tuple[int, int]]) -> DataFrame:
    """Scan rows that pass the breakout prefilter of at least one window, one row per (bar, window).

    ``neck`` gives, per window, the length and lag of the rolling neckline.
    """
    size = max(w.bars for w in cfg.windows)
    b = with_now(clean_bars(bars), cfg.ma_window, cfg.volume_enable)
    b = b.withColumns({f"_nk_{w.name}": BARS.high("close", neck[w.name][0], lag=neck[w.name][1]) for w in cfg.windows})
    rows = scan_rows(b, size, cfg.scan)
    choices = []
    for o, w in enumerate(cfg.windows):
        nk = F.col(f"_nk_{w.name}")
        dist = F.when(nk > 0, F.col("close") / nk - 1.0)
        ok = (F.col("rn") >= w.bars) & (dist > cfg.min_breakout_distance_pct) & (dist <= cfg.max_breakout_distance_pct)
        choices.append(F.when(holds(ok), F.struct(F.lit(w.name).alias("window"), F.lit(w.bars).alias("len"), F.lit(o).alias("w_ord"))))
    rows = rows.withColumn("_ws", F.array_compact(F.array(*choices))).where(F.size("_ws") > 0)
    rows = rows.select("ts_code", "rn", F.col("trade_date").alias("asof_date"), F.col("close").alias("now"), "volume_ratio_20", "ret_1d", "ret_3d", "_ws")
    packed = attach_windows(rows, b, size)
    packed = packed.select("*", F.inline("_ws")).drop("_ws")
    return step(packed, win=F.slice("w", F.size("w") - F.col("len") + 1, F.col("len"))).drop("w").withColumnRenamed("win", "w")


def prefilter(bars: DataFrame, length: int, lag: int, low: float, high: float) -> DataFrame:
    """Bars whose close is above, but not far above, the rolling neckline."""
    nk = BARS.high("close", length, lag=lag)
    b = clean_bars(bars).withColumn("neckline", nk)
    return b.withColumn("distance", F.when(F.col("neckline") > 0, F.col("close") / F.col("neckline") - 1.0)).where(
        (F.col("distance") > low) & (F.col("distance") <= high)
    )


def _bar_at(i: Column) -> Column:
    """Window element at absolute position i."""
    return F.get(F.col("w"), (i - (F.col("rn") - F.col("len")) - 1).cast("int"))


def _common_columns(cfg, miner: str, base_range: Column) -> list[Column]:
    sid = F.concat_ws("_", "ts_code", F.date_format("asof_date", "yyyy-MM-dd"), F.lit(miner), "window")
    return [
        sid.alias("sample_id"),
        F.col("ts_code"),
        F.col("asof_date"),
        F.lit(cfg.label).alias("label"),
        F.lit(cfg.label_source).alias("label_source"),
        F.lit(cfg.confidence).alias("confidence"),
        sid.alias("event_id"),
        F.lit(miner).alias("miner_name"),
        F.col("candidate_score"),
        F.col("now").alias("close"),
        F.col("ret_1d"),
        F.col("ret_3d"),
        F.col("volume_ratio_20").alias("vol_ratio_1d"),
        F.col("len").alias("base_window_days"),
        base_range.alias("base_range_pct"),
        F.lit(True).alias("breakout_flag"),
    ]


# ---------------------------------------------------------------- bottom-base breakout


@dataclass(frozen=True)
class BottomBase:
    label: int = 1
    label_source: str = "rule_bottom_base_breakout"
    confidence: float = 0.65
    scan: ScanRows = field(default_factory=ScanRows)
    windows: tuple[Lookback, ...] = (Lookback("short", 120), Lookback("medium", 252), Lookback("long", 504), Lookback("extra_long", 756))
    min_prior_drawdown_pct: float = 0.18
    min_base_duration_bars: int = 40
    max_base_range_pct: float = 0.50
    max_base_close_std_pct: float = 0.22
    min_neckline_rebound_from_base_low_pct: float = 0.08
    min_touches_in_base_zone: int = 2
    base_zone_pct: float = 0.12
    min_breakout_distance_pct: float = 0.0
    max_breakout_distance_pct: float = 0.08
    max_breakout_recency_bars: int = 15
    min_right_recovery_pct: float = 0.10
    min_close_vs_base_low_pct: float = 0.12
    volume_enable: bool = True
    ma_window: int = 20
    breakout_volume_ratio: float = 1.10
    weights: tuple[float, ...] = (0.15, 0.25, 0.15, 0.20, 0.15, 0.10)

    @classmethod
    def from_dict(cls, data: dict | None) -> "BottomBase":
        return cls(**_flatten(cls, data))

    def base_bars(self, lookback: int) -> int:
        return max(self.min_base_duration_bars, lookback // 2)


def neckline_of_base(base: Column, guard: int, length: Column) -> Column:
    """Highest close (first on ties) of a base without its last ``guard`` bars, or without the last bar if short."""
    cut = F.when(length > guard + 5, length - guard).otherwise(length - 1)
    return _first_max(F.slice(base, F.lit(1), cut.cast("int")), "c")


def bottom_base_breakout(bars: DataFrame, cfg: BottomBase = BottomBase()) -> DataFrame:
    guard = max(1, cfg.max_breakout_recency_bars)
    neck = {w.name: (max(5, cfg.base_bars(w.bars) - guard), guard) for w in cfg.windows}
    rows = survivors(bars, cfg, neck)
    base_len = F.greatest(F.lit(cfg.min_base_duration_bars), F.floor(F.col("len") / 2)).cast("int")
    rows = step(rows, base_len=base_len).where(F.col("len") >= F.col("base_len") + 2)
    rows = step(rows, base=F.slice("w", F.col("len") - F.col("base_len") + 1, F.col("base_len")))
    rows = step(rows, nk=neckline_of_base(F.col("base"), guard, F.col("base_len"))).where("nk.v > 0")
    rows = step(rows, brk=first_crossing(F.col("w"), F.col("nk.i"), F.col("nk.v") * (1.0 + cfg.min_breakout_distance_pct)))
    rows = step(rows, recency=F.col("rn") - F.col("brk"), distance=F.col("now") / F.col("nk.v") - 1.0)
    rows = rows.where(
        F.col("recency").between(0, cfg.max_breakout_recency_bars)
        & F.col("distance").between(cfg.min_breakout_distance_pct, cfg.max_breakout_distance_pct)
    )
    rows = step(rows, quiet=F.filter("base", lambda x: x["i"] < F.col("brk"))).where(
        F.size("quiet") >= cfg.min_base_duration_bars
    )
    closes = F.transform("quiet", lambda x: x["c"])
    rows = step(rows, low=_first_min(F.col("quiet"), "l"), top=F.array_max(closes), mean=_mean(closes))
    rows = step(
        rows,
        base_range=(F.col("top") - F.col("low.v")) / F.col("low.v"),
        base_std=_std_over_mean(closes, F.col("mean")),
        prior=_first_max(F.filter("w", lambda x: x["i"] < F.col("low.i")), "h"),
        touches=F.size(F.filter("quiet", lambda x: x["c"] <= F.col("low.v") * (1.0 + cfg.base_zone_pct))),
    )
    rows = step(
        rows,
        drawdown=(F.col("prior.v") - F.col("low.v")) / F.col("prior.v"),
        rebound=F.col("nk.v") / F.col("low.v") - 1.0,
        recovery=F.col("now") / F.col("low.v") - 1.0,
    )
    rows = rows.where(
        (F.col("low.v") > 0)
        & (F.col("base_range") <= cfg.max_base_range_pct)
        & (F.col("base_std") <= cfg.max_base_close_std_pct)
        & (F.col("drawdown") >= cfg.min_prior_drawdown_pct)
        & (F.col("rebound") >= cfg.min_neckline_rebound_from_base_low_pct)
        & (F.col("recovery") >= max(cfg.min_right_recovery_pct, cfg.min_close_vs_base_low_pct))
        & (F.col("touches") >= cfg.min_touches_in_base_zone)
    )
    vol_ok = (F.col("volume_ratio_20") >= cfg.breakout_volume_ratio) & F.lit(cfg.volume_enable)
    one = F.lit(1.0)
    mid = max(cfg.max_breakout_distance_pct * 0.5, 1e-9)
    stable = (
        clamp(one - F.col("base_range") / max(cfg.max_base_range_pct, 1e-9))
        + clamp(one - F.col("base_std") / max(cfg.max_base_close_std_pct, 1e-9))
    ) / 2.0
    parts = [
        clamp(F.col("drawdown") / max(cfg.min_prior_drawdown_pct * 2, 1e-9)),
        stable,
        clamp(F.col("rebound") / max(cfg.min_neckline_rebound_from_base_low_pct * 2, 1e-9)),
        clamp(one - F.col("recency") / max(float(cfg.max_breakout_recency_bars), 1.0)),
        clamp(one - F.abs(F.col("distance") - mid) / mid),
        vol_ok.cast("double"),
    ]
    weights = [*cfg.weights[:5], cfg.weights[5] if cfg.volume_enable else 0.0]
    rows = step(rows, candidate_score=weighted_mean(list(zip(parts, weights))))
    flags = F.concat_ws(
        ";",
        number_flag("prior_drawdown", F.col("drawdown")),
        number_flag("base_range", F.col("base_range")),
        number_flag("breakout_distance", F.col("distance")),
        F.format_string("touches=%d", F.col("touches")),
        F.when(vol_ok, "volume_breakout_ok"),
    )
    out = rows.select(
        *_common_columns(cfg, "bottom_base_breakout", F.col("base_range")),
        flags.alias("rule_flags"),
        "window",
        F.lit("bottom_base_recent_breakout").alias("pattern_stage"),
        _bar_at(F.col("prior.i"))["d"].alias("prior_high_date"),
        F.col("prior.v").alias("prior_high_price"),
        _bar_at(F.col("low.i"))["d"].alias("base_low_date"),
        F.col("low.v").alias("base_low_price"),
        F.col("top").alias("base_high_price"),
        F.col("base_std").alias("base_close_std_pct"),
        _bar_at(F.col("nk.i"))["d"].alias("neckline_date"),
        F.col("nk.v").alias("neckline_price"),
        _bar_at(F.col("brk"))["d"].alias("breakout_date"),
        F.col("distance").alias("breakout_distance_pct"),
        F.col("recency").alias("breakout_recency_bars"),
        F.col("drawdown").alias("prior_drawdown_pct"),
        F.col("rebound").alias("neckline_rebound_from_base_low_pct"),
        F.col("touches").alias("touches_in_base_zone"),
        "volume_ratio_20",
    )
    return spaced_selection(
        out, ["ts_code", "window"], cfg.scan.min_days_between_candidates, cfg.scan.max_candidates_per_symbol, tie="base_window_days"
    )


# ---------------------------------------------------------------- long-base breakout


@dataclass(frozen=True)
class MonthlyTrend:
    enable: bool = False
    min_months: int = 36
    ma_window_months: int = 12
    slope_months: int = 6
    lookback_months: int = 24
    min_ma_slope_pct: float = 0.02
    min_lookback_return_pct: float = 0.0
    min_close_vs_ma_pct: float = -0.05


def monthly_trend(rows: DataFrame, bars: DataFrame, cfg: MonthlyTrend) -> DataFrame:
    """Attach monthly metrics at each row's date (column ``asof_date``, close ``now``).

    The current month counts with the as-of close; earlier months with their last close.
    """
    w = W.partitionBy("ts_code").orderBy("month")
    n, s, k = cfg.ma_window_months, cfg.slope_months, cfg.lookback_months
    months = bars.groupBy("ts_code", F.trunc("trade_date", "MM").alias("month")).agg(F.max_by("close", "trade_date").alias("mc"))
    frame = lambda a, b: w.rowsBetween(a, b)
    prior_frame = frame(-(n - 1) - s, -s)
    months = months.select(
        "ts_code",
        "month",
        F.row_number().over(w).alias("monthly_trend_months"),
        F.coalesce(F.sum("mc").over(frame(-(n - 1), -1)) if n > 1 else F.lit(0.0), F.lit(0.0)).alias("__before"),
        F.when(F.count("mc").over(prior_frame) == n, F.avg("mc").over(prior_frame)).alias("__prior_ma"),
        F.lag("mc", k).over(w).alias("__prior_close"),
    )
    out = rows.withColumn("month", F.trunc("asof_date", "MM")).join(months, ["ts_code", "month"], "left")
    ma = F.when(F.col("monthly_trend_months") >= n, (F.col("__before") + F.col("now")) / n)
    out = out.withColumn("__ma", ma)
    return out.withColumns(
        {
            "monthly_trend_return_pct": positive_change(F.col("now"), F.col("__prior_close")),
            "monthly_trend_ma_slope_pct": positive_change(F.col("__ma"), F.col("__prior_ma")),
            "monthly_close_vs_ma_pct": positive_change(F.col("now"), F.col("__ma")),
        }
    ).drop("month", "__before", "__prior_ma", "__prior_close", "__ma")


def monthly_gate(rows: DataFrame, bars: DataFrame, cfg: MonthlyTrend) -> DataFrame:
    if not cfg.enable:
        none = {c: F.lit(None).cast("double") for c in ("monthly_trend_return_pct", "monthly_trend_ma_slope_pct", "monthly_close_vs_ma_pct")}
        return rows.withColumns({"monthly_trend_ok": F.lit(True), "monthly_trend_months": F.lit(None).cast("int"), **none})
    need = max(cfg.min_months, cfg.ma_window_months + cfg.slope_months + 1, cfg.lookback_months + 1)
    out = monthly_trend(rows, bars, cfg).where(
        (F.col("monthly_trend_months") >= need)
        & (F.col("monthly_trend_ma_slope_pct") >= cfg.min_ma_slope_pct)
        & (F.col("monthly_trend_return_pct") >= cfg.min_lookback_return_pct)
        & (F.col("monthly_close_vs_ma_pct") >= cfg.min_close_vs_ma_pct)
    )
    return out.withColumn("monthly_trend_ok", F.lit(True))


@dataclass(frozen=True)
class LongBase:
    label: int = 1
    label_source: str = "rule_long_base_breakout"
    confidence: float = 0.70
    scan: ScanRows = field(default_factory=lambda: ScanRows(asof_stride=10, max_candidates_per_symbol=80, min_days_between_candidates=60))
    windows: tuple[Lookback, ...] = (Lookback("one_year", 252), Lookback("two_year", 504), Lookback("three_year", 756), Lookback("four_year", 1008))
    min_prior_drawdown_pct: float = 0.20
    min_base_duration_bars: int = 252
    support_zone_tolerance_pct: float = 0.15
    min_support_touches: int = 2
    min_support_touch_separation_bars: int = 40
    max_support_zone_std_pct: float = 0.12
    min_neckline_rebound_from_support_pct: float = 0.15
    max_neckline_to_prior_high_ratio: float = 0.90
    min_breakout_distance_pct: float = 0.0
    max_breakout_distance_pct: float = 0.10
    max_breakout_recency_bars: int = 20
    min_right_side_duration_bars: int = 40
    volume_enable: bool = True
    ma_window: int = 20
    breakout_volume_ratio: float = 1.10
    monthly: MonthlyTrend = field(default_factory=MonthlyTrend)
    weights: tuple[float, ...] = (0.15, 0.25, 0.15, 0.15, 0.10, 0.15, 0.05)

    @classmethod
    def from_dict(cls, data: dict | None) -> "LongBase":
        out = _flatten(cls, data)
        if isinstance((data or {}).get("monthly_trend"), dict):
            out["monthly"] = MonthlyTrend(**_known(MonthlyTrend, data["monthly_trend"]))
        return cls(**out)

    def base_bars(self, lookback: int) -> int:
        shortest, recent = self.min_base_duration_bars, max(1, self.max_breakout_recency_bars)
        return min(lookback, max(int(lookback * 0.75), shortest + (recent if lookback >= shortest + recent else 0)))


def neckline_in_band(source: Column, low: Column, high: Column) -> Column:
    """Highest close inside the band; otherwise the close nearest the 85 percent quantile if that lies inside."""
    closes = F.transform(source, lambda x: x["c"])
    inside = F.filter(source, lambda x: (x["c"] >= low) & (x["c"] <= high))
    q85 = array_quantile(closes, 0.85)
    near = F.array_min(F.transform(source, lambda x: F.struct(F.abs(x["c"] - q85).alias("gap"), x["i"].alias("i"), x["c"].alias("v"))))
    fallback = F.when((q85 >= low) & (q85 <= high), F.struct(near["v"].alias("v"), near["i"].alias("i")))
    return F.when(F.size(source) >= 5, F.when(F.size(inside) > 0, _first_max(inside, "c")).otherwise(fallback))


def long_base_breakout(bars: DataFrame, cfg: LongBase = LongBase()) -> DataFrame:
    recent = max(1, cfg.max_breakout_recency_bars)
    neck = {w.name: (max(20, int(w.bars * 0.45)), recent) for w in cfg.windows}
    rows = survivors(bars, cfg, neck)
    pick = lambda f: F.element_at(F.create_map(*[x for w in cfg.windows for x in (F.lit(w.name), F.lit(f(w.bars)))]), F.col("window"))
    rows = step(rows, base_len=pick(cfg.base_bars), head=pick(lambda n: max(1, int(n * 0.45))))
    need = max(int(cfg.min_base_duration_bars * 0.75), cfg.min_support_touch_separation_bars * max(1, cfg.min_support_touches - 1) + 1)
    rows = rows.where((F.col("base_len") >= cfg.min_base_duration_bars) & (F.col("base_len") - recent >= need))
    rows = step(
        rows,
        base=F.slice("w", F.col("len") - F.col("base_len") + 1, F.col("base_len")),
        prior=_first_max(F.slice("w", F.lit(1), F.col("head")), "h"),
    )
    rows = step(rows, pre=F.slice("base", F.lit(1), F.col("base_len") - recent)).where("prior.v > 0")
    pooled = F.concat(F.transform("pre", lambda x: x["c"]), F.transform("pre", lambda x: x["l"]))
    rows = step(rows, support=array_quantile(pooled, 0.10)).where("support > 0")
    zone = F.col("support") * (1.0 + cfg.support_zone_tolerance_pct)
    rows = step(rows, touch=separated_touches(F.filter("pre", lambda x: x["c"] <= zone), cfg.min_support_touch_separation_bars))
    rows = rows.where(F.size("touch") >= cfg.min_support_touches)
    prices = F.transform("touch", lambda x: x["c"])
    rows = step(
        rows,
        zone_std=_std_over_mean(prices, _mean(prices)),
        first_i=F.get("touch", F.lit(0))["i"],
        last_i=F.element_at("touch", -1)["i"],
        drawdown=(F.col("prior.v") - F.col("support")) / F.col("prior.v"),
    ).where((F.col("zone_std") <= cfg.max_support_zone_std_pct) & (F.col("drawdown") >= cfg.min_prior_drawdown_pct))
    source = F.filter("pre", lambda x: x["i"] > F.col("first_i"))
    rows = step(rows, src=source)
    rows = step(
        rows,
        nk=neckline_in_band(
            F.col("src"),
            F.col("support") * (1.0 + cfg.min_neckline_rebound_from_support_pct),
            F.col("prior.v") * cfg.max_neckline_to_prior_high_ratio,
        ),
    ).where("nk is not null")
    rows = step(
        rows,
        rebound=F.col("nk.v") / F.col("support") - 1.0,
        to_high=F.col("nk.v") / F.col("prior.v"),
        brk=first_crossing(F.col("base"), F.col("nk.i"), F.col("nk.v") * (1.0 + cfg.min_breakout_distance_pct)),
    )
    rows = step(
        rows, recency=F.col("rn") - F.col("brk"), distance=F.col("now") / F.col("nk.v") - 1.0, right_side=F.col("brk") - F.col("last_i")
    )
    rows = rows.where(
        (F.col("rebound") >= cfg.min_neckline_rebound_from_support_pct)
        & (F.col("to_high") <= cfg.max_neckline_to_prior_high_ratio)
        & F.col("recency").between(0, cfg.max_breakout_recency_bars)
        & (F.col("distance") > cfg.min_breakout_distance_pct)
        & (F.col("distance") <= cfg.max_breakout_distance_pct)
        & (F.col("right_side") >= cfg.min_right_side_duration_bars)
    )
    rows = monthly_gate(rows, clean_bars(bars), cfg.monthly)
    vol_ok = (F.col("volume_ratio_20") >= cfg.breakout_volume_ratio) & F.lit(cfg.volume_enable)
    one = F.lit(1.0)
    mid = max(cfg.max_breakout_distance_pct * 0.4, 1e-9)
    neck_score = (
        clamp(F.col("rebound") / max(cfg.min_neckline_rebound_from_support_pct * 2, 1e-9))
        + clamp(one - F.col("to_high") / max(cfg.max_neckline_to_prior_high_ratio, 1e-9))
    ) / 2.0
    parts = [
        clamp(F.col("drawdown") / max(cfg.min_prior_drawdown_pct * 2, 1e-9)),
        clamp(one - F.col("zone_std") / max(cfg.max_support_zone_std_pct, 1e-9)),
        neck_score,
        clamp(one - F.col("recency") / max(float(cfg.max_breakout_recency_bars), 1.0)),
        clamp(one - F.abs(F.col("distance") - mid) / mid),
        clamp(F.col("base_len") / 756.0),
        vol_ok.cast("double"),
    ]
    weights = [*cfg.weights[:6], cfg.weights[6] if cfg.volume_enable else 0.0]
    rows = step(rows, candidate_score=weighted_mean(list(zip(parts, weights))))
    flags = F.concat_ws(
        ";",
        number_flag("prior_drawdown", F.col("drawdown")),
        F.format_string("support_touches=%d", F.size("touch")),
        number_flag("breakout_distance", F.col("distance")),
        F.when(vol_ok, "volume_breakout_ok"),
    )
    text = F.array_join(F.transform("touch", lambda x: F.date_format(x["d"], "yyyy-MM-dd")), ",")
    out = rows.select(
        *_common_columns(cfg, "long_base_breakout", F.lit(None).cast("double")),
        flags.alias("rule_flags"),
        "window",
        F.lit("long_base_recent_breakout").alias("pattern_stage"),
        _bar_at(F.col("prior.i"))["d"].alias("prior_high_date"),
        F.col("prior.v").alias("prior_high_price"),
        F.col("support").alias("support_price"),
        zone.alias("support_zone_upper"),
        F.size("touch").alias("support_touch_count"),
        text.alias("support_touch_dates"),
        (F.col("last_i") - F.col("first_i")).alias("support_touch_span_bars"),
        F.col("zone_std").alias("support_zone_std_pct"),
        F.get("base", F.lit(0))["d"].alias("base_start_date"),
        F.col("asof_date").alias("base_end_date"),
        F.col("base_len").alias("base_duration_bars"),
        _bar_at(F.col("nk.i"))["d"].alias("neckline_date"),
        F.col("nk.v").alias("neckline_price"),
        F.col("rebound").alias("neckline_rebound_from_support_pct"),
        F.col("to_high").alias("neckline_to_prior_high_ratio"),
        _bar_at(F.col("brk"))["d"].alias("breakout_date"),
        _bar_at(F.col("brk"))["c"].alias("breakout_price"),
        F.col("distance").alias("breakout_distance_pct"),
        F.col("recency").alias("breakout_recency_bars"),
        F.col("right_side").alias("right_side_duration_bars"),
        "monthly_trend_ok", "monthly_trend_months", "monthly_trend_return_pct", "monthly_trend_ma_slope_pct", "monthly_close_vs_ma_pct",
        F.col("drawdown").alias("prior_drawdown_pct"),
        "volume_ratio_20",
    )
    return spaced_selection(
        out, ["ts_code"], cfg.scan.min_days_between_candidates, cfg.scan.max_candidates_per_symbol, tie="base_window_days"
    )
