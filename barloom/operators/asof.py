"""As-of join: each left row gets the latest (earliest, closest) right row of its entity.

Left and right are first reduced to one row per (entity, instant), which collapses hot instants before any window.  An
entity of unbounded size is then range-partitioned on (entity, instant): every partition holds a similar number of
instants however the entities are distributed, and the last known right row of the earlier partitions is carried in.
With ``bounded=True`` (entities limited by the calendar, a few left rows a day) a plain window per entity, through which
the left rows go themselves, is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import ensure_checkpoint_dir

_BITS = 33


def _instants(left, right, on, by, values, tie, last: bool) -> DataFrame:
    """One row per (entity, instant) with the winning right row, if any."""
    payload = F.struct(F.col(on).alias("__on"), *values)
    order = F.struct(*values) if tie is None else F.col(tie)
    marked = right.where(F.col(on).isNotNull()).select(*by, on, payload.alias("__v"), order.alias("__t"))
    keys = left.where(F.col(on).isNotNull()).select(*by, on)
    both = marked.unionByName(keys, allowMissingColumns=True)
    pick = F.max_by if last else F.min_by
    return both.groupBy(*by, on).agg(pick("__v", "__t").alias("__v"))


def _fill_bounded(left, right, on, by, values, tie, backward: bool) -> DataFrame:
    """Match per entity in one window over the right rows (one per instant, or ordered by ``tie``) and the left instants."""
    order = F.lit(0) if tie is None else F.col(tie)
    # at one instant right rows come first going backward and last going forward
    r = right.where(F.col(on).isNotNull()).select(
        *by, on, F.lit(0 if backward else 1).alias("__k"), order.alias("__t"), F.struct(F.col(on).alias("__on"), *values).alias("__v")
    )
    keys = left.where(F.col(on).isNotNull()).select(*by, on).distinct().withColumn("__k", F.lit(1 if backward else 0))
    both = r.unionByName(keys, allowMissingColumns=True)
    spec = W.partitionBy(*by).orderBy(on, "__k", "__t")
    if backward:
        v = F.last("__v", ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, 0))
    else:
        v = F.first("__v", ignorenulls=True).over(spec.rowsBetween(0, W.unboundedFollowing))
    filled = both.select(*by, on, "__k", v.alias("__f"))
    return filled.where(F.col("__k") == F.lit(1 if backward else 0)).select(*by, on, F.col("__f").alias("__v"))


def _match_bounded(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[Column], tie: str | None, backward: bool) -> DataFrame:
    """Left rows with the matching right row ``__v``: both sides go through one window per entity, and no join follows."""
    order = F.lit(None) if tie is None else F.col(tie)
    found = F.struct(F.col(on).alias("__on"), *values)
    r = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(0 if backward else 1).alias("__k"), order.alias("__t"), found.alias("__v"))
    rows = left.select(*by, on, F.lit(1 if backward else 0).alias("__k"), F.struct(*left.columns).alias("__l"))
    both = r.unionByName(rows, allowMissingColumns=True)
    # a left row without an instant lies where no right row is seen
    at = F.asc_nulls_first(on) if backward else F.asc_nulls_last(on)
    spec = W.partitionBy(*by).orderBy(at, "__k", "__t")
    if backward:
        v = F.last("__v", ignorenulls=True).over(spec.rowsBetween(W.unboundedPreceding, 0))
    else:
        v = F.first("__v", ignorenulls=True).over(spec.rowsBetween(0, W.unboundedFollowing))
    return both.select("__k", "__l", v.alias("__v")).where(F.col("__k") == F.lit(1 if backward else 0)).select("__l.*", "__v")


def _fill_spread(inst: DataFrame, on: str, by: list[str], backward: bool) -> DataFrame:
    ensure_checkpoint_dir(inst.sparkSession)
    order = [*by, on]
    placed = (
        inst.repartitionByRange(*order)
        .withColumn("__p", F.shiftright(F.monotonically_increasing_id(), _BITS))
        .checkpoint()
    )
    inside = W.partitionBy("__p", *by).orderBy(on)
    # at most one row per (partition, entity): an entity has no more of them than there are partitions
    edge = placed.where("__v is not null").groupBy("__p", *by)
    pick = F.max_by if backward else F.min_by
    edges = edge.agg(pick("__v", on).alias("__e"))
    groups = placed.select("__p", *by).distinct()
    cond = [F.col("g.__p") == F.col("e.__p")] + [F.col(f"g.{b}").eqNullSafe(F.col(f"e.{b}")) for b in by]
    joined = groups.alias("g").join(edges.alias("e"), cond, "left").select("g.__p", *[F.col(f"g.{b}").alias(b) for b in by], "e.__e")
    across = W.partitionBy(*by).orderBy("__p") if by else W.orderBy("__p")
    if backward:
        v = F.last("__v", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
        carried = F.last("__e", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))
    else:
        v = F.first("__v", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))
        carried = F.first("__e", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing))
    carry = joined.select("__p", *by, carried.alias("__c"))
    own = placed.select("__p", *by, on, v.alias("__v"))
    cond = [F.col("o.__p") == F.col("c.__p")] + [F.col(f"o.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by]
    out = own.alias("o").join(carry.alias("c"), cond, "left")
    return out.select(*[F.col(f"o.{b}").alias(b) for b in by], F.col(f"o.{on}").alias(on), F.coalesce("o.__v", "c.__c").alias("__v"))


def _gap(a: Column, b: Column, numeric: bool) -> Column:
    if numeric:
        return F.abs(a - b)
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: str | list[str] | None = None,
    direction: str = "backward",
    *,
    tie: str | None = None,
    bounded: bool = False,
    left_order: str | None = None,
    matched_on: str | None = None,
) -> DataFrame:
    """Keep every left row and attach the right columns (suffix ``_right`` on a name clash).

    Exact matches count.  Among right rows at one instant the last by ``tie`` wins going backward, the first going
    forward; on equal distance the earlier row is the nearest.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unsupported direction: {direction}")
    by = [by] if isinstance(by, str) else list(by or [])
    names = [c for c in right.columns if c != on and c not in by]
    out_names = {c: f"{c}_right" if c in left.columns else c for c in names}
    values = [F.col(c) for c in names] or [F.lit(True).alias("__any")]
    if bounded and by and direction != "nearest":
        found = _match_bounded(left, right, on, by, values, tie, direction == "backward")
        out = found.select(
            *left.columns,
            *[F.col("__v")[c].alias(n) for c, n in out_names.items()],
            *([F.col("__v")["__on"].alias(matched_on)] if matched_on else []),
        )
        return out.orderBy(left_order) if left_order else out
    wanted = {"backward": [True], "forward": [False], "nearest": [True, False]}[direction]
    found = None
    for backward in wanted:
        if bounded and by:
            part = _fill_bounded(left, right, on, by, values, tie, backward)
        else:
            part = _fill_spread(_instants(left, right, on, by, values, tie, backward), on, by, backward)
        part = part.withColumnRenamed("__v", "__b" if backward else "__f")
        if found is None:
            found = part
        else:
            cond = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*by, on]]
            found = found.alias("x").join(part.alias("y"), cond).select(*[F.col(f"x.{k}").alias(k) for k in [*by, on]], "__b", "__f")
    if direction == "nearest":
        numeric = dict(left.dtypes)[on] in ("tinyint", "smallint", "int", "bigint", "float", "double") or "decimal" in dict(left.dtypes)[on]
        back, fwd = _gap(F.col(on), F.col("__b.__on"), numeric), _gap(F.col("__f.__on"), F.col(on), numeric)
        best = F.when(F.col("__b").isNull(), F.col("__f")).when(F.col("__f").isNull() | (back <= fwd), F.col("__b")).otherwise(F.col("__f"))
    else:
        best = F.col("__b" if direction == "backward" else "__f")
    found = found.withColumn("__v", best)
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in by] + [F.col(f"l.{on}") == F.col(f"m.{on}")]
    out = left.alias("l").join(found.alias("m"), cond, "left").select(
        "l.*",
        *[F.col(f"m.__v.{c}").alias(n) for c, n in out_names.items()],
        *([F.col("m.__v.__on").alias(matched_on)] if matched_on else []),
    )
    return out.orderBy(left_order) if left_order else out
