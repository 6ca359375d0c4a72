"""Trailing windows over the bars of one entity, all bars at a time.

Spark goes through a sliding frame anew for every row; here each step of a frame is one numpy operation on all bars of an
entity.  Sums and deviations take a frame from its oldest bar to its newest, as Spark's window functions do, so the values
are the same to the last bit.  A group is one entity, which the calendar bounds.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.windows import BARS


# workers get this module with the functions that use it: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Series:
    """Values in time order and which of them are known."""

    def __init__(self, values: np.ndarray, known: np.ndarray) -> None:
        self.values, self.known = values, known

    def __len__(self) -> int:
        return len(self.values)

    def lag(self, n: int) -> "Series":
        """The value ``n`` rows ago."""
        if n == 0:
            return self
        v, k = np.zeros(len(self)), np.zeros(len(self), bool)
        v[n:], k[n:] = self.values[: max(len(self) - n, 0)], self.known[: max(len(self) - n, 0)]
        return Series(v, k)

    def last_known(self) -> "Series":
        at = np.maximum.accumulate(np.where(self.known, np.arange(len(self)), -1))
        return Series(self.values[np.maximum(at, 0)], at >= 0)

    def change(self, n: int) -> "Series":
        """Relative change over ``n`` rows; unknown where the earlier value is 0."""
        before = self.lag(n)
        known = self.known & before.known & (before.values != 0)
        return Series(self.values / np.where(known, before.values, 1.0) - 1.0, known)

    def above(self, other: "Series") -> "Series":
        """1 where the value is greater, else 0."""
        return Series((self.values > other.values).astype(float), self.known & other.known)

    def filled(self, fill: float) -> np.ndarray:
        return np.where(self.known, self.values, fill)

    def count(self, n: int, lag: int = 0) -> np.ndarray:
        """Known values among the ``n`` rows ending ``lag`` rows ago."""
        total = np.concatenate([[0], np.cumsum(self.known)])
        end = np.arange(1, len(self) + 1) - lag
        return total[np.maximum(end, 0)] - total[np.maximum(end - n, 0)]

    def _enough(self, values: np.ndarray, n: int, lag: int, min_periods: int | None) -> "Series":
        return Series(values, self.count(n, lag) >= max(n if min_periods is None else min_periods, 1))

    def mean(self, n: int, *, lag: int = 0, min_periods: int | None = None) -> "Series":
        x, total = self.filled(0.0), np.zeros(len(self))
        for back in range(min(lag + n, len(self)) - 1, lag - 1, -1):
            total[back:] += x[: len(x) - back]
        return self._enough(total / np.maximum(self.count(n, lag), 1), n, lag, min_periods)

    def std(self, n: int, *, sample: bool = False, lag: int = 0, min_periods: int | None = None) -> "Series":
        """Deviation by the running update of count, mean and squares that Spark uses."""
        size = len(self)
        x, seen, avg, squares = self.filled(0.0), np.zeros(size), np.zeros(size), np.zeros(size)
        whole = bool(self.known.all())
        for back in range(min(lag + n, size) - 1, lag - 1, -1):
            m, c = avg[back:], seen[back:]
            delta = x[: size - back] - m
            if whole:
                c += 1.0
                step = delta / c
            else:
                delta[~self.known[: size - back]] = 0.0
                c += self.known[: size - back]
                step = delta / np.maximum(c, 1.0)
            m += step
            squares[back:] += delta * (delta - step)
        out = self._enough(np.sqrt(squares / np.maximum(seen - sample, 1.0)), n, lag, min_periods)
        return Series(out.values, out.known & (seen > 1)) if sample else out

    def _extreme(self, pick, fill: float, n: int, lag: int, min_periods: int | None) -> "Series":
        x = self.lag(lag).filled(fill)
        span = 1
        while span < n:
            # a stretch of ``span`` rows is joined with the one that ends ``step`` rows earlier; overlaps do no harm
            step = min(span, n - span)
            older = np.full(len(x), fill)
            older[step:] = x[: max(len(x) - step, 0)]
            x, span = pick(older, x), span + step
        return self._enough(x, n, lag, min_periods)

    def high(self, n: int, *, lag: int = 0, min_periods: int | None = None) -> "Series":
        return self._extreme(np.maximum, -np.inf, n, lag, min_periods)

    def low(self, n: int, *, lag: int = 0, min_periods: int | None = None) -> "Series":
        return self._extreme(np.minimum, np.inf, n, lag, min_periods)

    def quantiles(self, n: int, shares: list[float]) -> list["Series"]:
        """Linear quantiles of the known values of the last ``n`` rows."""
        size = len(self)
        padded = np.concatenate([np.full(n - 1, np.inf), self.filled(np.inf)])
        ordered = np.sort(np.lib.stride_tricks.sliding_window_view(padded, n), axis=1)
        seen, rows, out = self.count(n), np.arange(size), []
        for share in shares:
            at = (np.maximum(seen, 1) - 1) * share
            low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
            a, b = ordered[rows, low], ordered[rows, high]
            out.append(Series(np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b), seen > 0))
        return out

    def since_extreme(self, n: int, sign: int) -> "Series":
        """Rows since the highest (``sign`` 1) or lowest (-1) of the last ``n`` rows; ties go to the oldest."""
        x, at, span = sign * self.filled(-sign * np.inf), np.arange(len(self)), 1
        while span < n:
            step = min(span, n - span)
            old_x, old_at = np.full(len(x), -np.inf), np.zeros(len(x), at.dtype)
            old_x[step:], old_at[step:] = x[: max(len(x) - step, 0)], at[: max(len(x) - step, 0)]
            older = old_x >= x
            older[:step] = False
            x, at, span = np.where(older, old_x, x), np.where(older, old_at, at), span + step
        return Series((np.arange(len(self)) - at).astype(float), self.count(n) > 0)

    def first_high(self, n: int) -> tuple["Series", "Series", "Series"]:
        """Highest of the last ``n`` rows (the oldest among equals), rows since then, and the lowest up to that row."""
        size = len(self)
        x = self.filled(-np.inf)
        low, top, since, until = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size), np.full(size, np.inf)
        for back in range(min(n, size) - 1, -1, -1):
            now = x[: size - back]
            np.minimum(low[back:], np.where(self.known[: size - back], now, np.inf), out=low[back:])
            higher = now > top[back:]
            top[back:][higher] = now[higher]
            since[back:][higher] = back
            until[back:][higher] = low[back:][higher]
        some = self.count(n) > 0
        return Series(top, some), Series(since, some), Series(until, some)

    def drawdowns(self, spans: list[int]) -> dict[int, "Series"]:
        """Worst value/peak of the last n rows for each n: stretches of doubling length combined from two shorter ones."""

        def moved(part, n):
            if n == 0:
                return part
            out = []
            for x, fill in zip(part, (-np.inf, np.inf, np.inf)):
                y = np.full(len(x), fill)
                y[n:] = x[: max(len(x) - n, 0)]
                out.append(y)
            return tuple(out)

        def combine(old, new):
            # an absent stretch has peak -inf and low inf
            with np.errstate(all="ignore"):
                across = np.where(np.isfinite(old[0]) & np.isfinite(new[1]), new[1] / old[0], np.inf)
            return np.maximum(old[0], new[0]), np.minimum(old[1], new[1]), np.minimum(np.minimum(old[2], new[2]), across)

        levels = [(self.filled(-np.inf), self.filled(np.inf), np.where(self.known, 1.0, np.inf))]
        for k in range(1, max(spans).bit_length()):
            levels.append(combine(moved(levels[-1], 1 << (k - 1)), levels[-1]))
        found = {}
        for n in spans:
            acc, used = None, 0
            for k, level in enumerate(levels):
                if n >> k & 1:
                    part = moved(level, used)
                    acc = part if acc is None else combine(part, acc)
                    used += 1 << k
            found[n] = Series(acc[2], self.count(n) > 0)
        return found


def per_entity(bars: DataFrame, inputs: list[str], outputs: list[str], compute: Callable[[dict[str, Series]], dict[str, Series]]) -> DataFrame:
    """``bars`` with the double columns ``outputs`` that ``compute`` gets from the columns ``inputs`` of an entity.

    The index window brings each entity together in date order; a task then goes from entity to entity and holds the bars
    of one batch and of the entity that continues into the next.
    """
    kept, index = bars.columns, "__index"
    fields = [*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in outputs]]

    def entities(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        series = {}
        for c in inputs:
            x = pa.concat_arrays(table.column(c).chunks).cast(pa.float64())
            series[c] = x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(table.column(index).to_numpy() == 1)
        found = [compute({c: Series(v[a:b], k[a:b]) for c, (v, k) in series.items()}) for a, b in zip(starts, [*starts[1:], len(table)])]
        arrays = [pa.array(np.concatenate([f[n].values for f in found]), pa.float64(), mask=~np.concatenate([f[n].known for f in found])) for n in outputs]
        return pa.Table.from_arrays([*[table.column(c) for c in kept], *arrays], [*kept, *outputs])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = np.flatnonzero(held.column(index).to_numpy() == 1)
            if len(starts) > 1:
                yield from entities(held.slice(0, starts[-1])).to_batches()
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from entities(held).to_batches()

    placed = bars.withColumn(index, BARS.index()).sortWithinPartitions(BARS.entity, BARS.time)  # the window's own order
    return placed.mapInArrow(run, T.StructType(fields))


class Lookup:
    """Bars of some entities in date order, and the rows of the same entities that look bars up by their places."""

    def __init__(self, bars: dict[str, Series], entity: np.ndarray, day: np.ndarray, row_entity: np.ndarray, row_days: dict[str, Series]) -> None:
        self.bars, self.entity, self.row_entity, self.row_days = bars, entity, row_entity, row_days
        self.day, self.key = day, self._key(entity, day)
        #: place of the first bar of each row's entity
        self.first = np.searchsorted(entity, row_entity, "left")

    @staticmethod
    def _key(entity: np.ndarray, day: np.ndarray) -> np.ndarray:
        return (entity << 32) + (day.astype(np.int64) + (1 << 31))

    def at(self, name: str) -> np.ndarray:
        """Place of the entity's last bar on or before a day of each row; -1 without one."""
        day = self.row_days[name]
        place = np.searchsorted(self.key, self._key(self.row_entity, day.values), "right") - 1
        return np.where(day.known & (place >= self.first), place, -1)

    def on(self, name: str) -> np.ndarray:
        """Place of the entity's bar on a day of each row; -1 without one."""
        place = self.at(name)
        return np.where(place >= 0, np.where(self.day[place] == self.row_days[name].values, place, -1), -1) if len(self.day) else place

    def present(self) -> np.ndarray:
        """Whether the entity of each row has bars."""
        return np.searchsorted(self.entity, self.row_entity, "right") > self.first

    def each(self, compute: Callable[[dict[str, Series]], dict[str, Series]]) -> dict[str, Series]:
        """What ``compute`` gets from the bars of one entity, for all of them."""
        starts = np.flatnonzero(np.diff(self.entity, prepend=-1)) if len(self.entity) else [0]
        parts = [compute({c: Series(s.values[a:b], s.known[a:b]) for c, s in self.bars.items()}) for a, b in zip(starts, [*starts[1:], len(self.entity)])]
        return {n: Series(np.concatenate([p[n].values for p in parts]), np.concatenate([p[n].known for p in parts])) for n in parts[0]}

    def get(self, series: Series, place: np.ndarray, inside: np.ndarray | bool = True) -> Series:
        """Values at the given places; unknown where a place is not ``inside`` or negative."""
        inside = inside & (place >= 0)
        at = np.where(inside, place, 0)
        if not len(series):
            return Series(np.zeros(len(place)), np.zeros(len(place), bool))
        return Series(np.where(inside, series.values[at], 0.0), inside & series.known[at])

    def mean(self, series: Series, places: list[tuple[np.ndarray, np.ndarray]]) -> Series:
        """Mean of the known values at the places that are inside, taken in the given order."""
        total, seen = np.zeros(len(self.first)), np.zeros(len(self.first))
        for place, inside in places:
            x = self.get(series, place, inside)
            total += x.filled(0.0)
            seen += x.known
        return Series(total / np.maximum(seen, 1.0), seen > 0)

    def running(self, series: Series) -> tuple[Series, Series]:
        """Sum and number of the known values of the entity up to each bar."""
        total, known = np.empty(len(series)), np.ones(len(series), bool)
        x = series.filled(0.0)
        starts = np.flatnonzero(np.diff(self.entity, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(x)]):
            np.cumsum(x[a:b], out=total[a:b])
        seen = np.cumsum(series.known).astype(float)
        before = np.concatenate([[0.0], seen])[np.searchsorted(self.entity, self.entity, "left")] if len(x) else seen
        return Series(total, known), Series(seen - before, known)

    def last_known(self, known: np.ndarray) -> np.ndarray:
        """For each bar the place of the entity's last bar up to it that is ``known``; -1 without one."""
        place = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1)) if len(known) else np.zeros(0, int)
        return np.where(place >= np.searchsorted(self.entity, self.entity, "left"), place, -1)

    def extreme(self, series: Series, start: np.ndarray, end: np.ndarray, sign: int) -> Series:
        """Highest (``sign`` 1) or lowest (-1) known value from place ``start`` to ``end``: two stretches of doubled length that overlap."""
        out = np.full(len(start), -np.inf)
        size = np.where(start >= 0, end - start + 1, 0)
        level, span = sign * series.filled(-sign * np.inf), 1
        while (wanted := size >= span).any():
            now = wanted & (size < 2 * span)
            out[now] = np.maximum(level[start[now]], level[end[now] - span + 1])
            if len(level) <= span:
                break
            # the level's place i covers the bars i to i + 2 * span - 1
            level, span = np.maximum(level[:-span], level[span:]), 2 * span
        return Series(sign * out, out > -np.inf)


def beside_bars(
    rows: DataFrame, bars: DataFrame, days: dict[str, Column], inputs: list[str], outputs: list[str], compute: Callable[[Lookup], dict[str, Series]],
    distinct: bool = False,
) -> DataFrame:
    """``rows`` with the double columns ``outputs`` that ``compute`` gets from the columns ``inputs`` of their entity's bars.

    ``days`` are dates of a row by which it looks up bars.  Bars and rows move once, by entity; no join follows.  A task goes
    from entity to entity as in ``per_entity``.  With ``distinct`` equal rows are returned once.
    """
    key, time = BARS.entity, BARS.time
    fields = [*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in outputs]]
    known = bars.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    b = known.select(F.col(key).alias("__e"), F.lit(False).alias("__r"), F.unix_date(F.col(time).cast("date")).alias("__t"), *[F.col(c).cast("double").alias(f"__b_{c}") for c in inputs])
    mine = rows.select(F.col(key).alias("__e"), F.lit(True).alias("__r"), *[F.unix_date(d.cast("date")).alias(f"__d_{n}") for n, d in days.items()], F.struct(*rows.columns).alias("__l"))
    both = b.unionByName(mine, allowMissingColumns=True)
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(parts, "__e").sortWithinPartitions("__e", "__r", "__t")
    names, day_names = rows.columns, list(days)

    def numbers(table: pa.Table, name: str) -> Series:
        x = table.column(name).combine_chunks()
        x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        integer = pa.types.is_integer(x.type)
        return Series(x.fill_null(0 if integer else 0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))

    def starts_of(table: pa.Table) -> np.ndarray:
        code = pc.fill_null(table.column("__e"), "")
        changed = pc.not_equal(code.slice(1), code.slice(0, len(code) - 1)).to_numpy()
        return np.concatenate([[0], np.flatnonzero(changed) + 1])

    def entities(table: pa.Table) -> pa.Table:
        entity = np.zeros(table.num_rows, np.int64)
        entity[starts_of(table)[1:]] = 1
        entity = np.cumsum(entity)
        is_row = table.column("__r").to_numpy()
        bar_part, row_part = table.filter(pa.array(~is_row)), table.filter(pa.array(is_row))
        mine_entity = entity[is_row]
        if distinct and row_part.num_rows:
            flat = row_part.column("__l").combine_chunks()
            flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
            seen = pa.Table.from_arrays([*flat.flatten(), pa.array(np.arange(len(flat)))], [*names, "__i"])
            first = np.sort(seen.group_by(names, use_threads=False).aggregate([("__i", "min")]).column("__i_min").to_numpy())
            row_part, mine_entity = row_part.take(pa.array(first)), mine_entity[first]
        look = Lookup(
            {c: numbers(bar_part, f"__b_{c}") for c in inputs}, entity[~is_row], numbers(bar_part, "__t").values, mine_entity,
            {n: numbers(row_part, f"__d_{n}") for n in day_names},
        )
        with np.errstate(all="ignore"):
            found = compute(look)
        flat = row_part.column("__l").combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        return pa.Table.from_arrays([*flat.flatten(), *[pa.array(found[n].values.astype(float), pa.float64(), mask=~found[n].known) for n in outputs]], [*names, *outputs])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > 1 and (starts := starts_of(held))[-1] > 0:
                yield from entities(held.slice(0, starts[-1])).to_batches()
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from entities(held).to_batches()

    return placed.mapInArrow(run, T.StructType(fields))
