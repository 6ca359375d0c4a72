"""Hard negatives by a multiway tree of hyperplanes over the vectors (a geometric near-neighbour access tree).

A vector's components are ``floor(SCALE * x)``, its score with an anchor is their integer inner product.  With one more
component that brings every vector to the same length M, the distance to an anchor a falls as the score s grows
(d^2 = |a|^2 + M^2 - 2 s), so a range of scores is an annulus around the anchor.

A node of the tree has up to ``FAN`` split points; a vector goes to the nearest (the hyperplanes between them).  Split points
come from a bounded sample, every vector is placed.  Each split point stores the least and largest distance from it to the
vectors of each sibling subtree, over all vectors.  A search asks for the annulus between two scores: around a split point at
distance D of the anchor it lies between the spheres of max(lo - D, D - hi, 0) and D + hi, and a sibling whose stored range does not meet
that is left out.  Leaves are searched exactly.

Positives are the best rows of the anchor's label: the search is for scores from that of the best in the sample upwards.
Negatives are the best rows of other labels with a score in a window below a positive's: again the sample raises the lower
end.  Bounds from the sample are scores of real rows, so nothing is lost by them.

Vectors that agree in label and components are one row with its smallest ids, as many as can be asked for, and so are
anchors.  Leaves are dealt in blocks of about ``LEAF_ROWS`` rows and anchors in blocks of ``ANCHORS``; a task holds one of
each, whatever a leaf holds.

Rows with a null label, id or vector or a null or non-finite component take no part.  Vectors of different lengths count as
filled up with zeros.  Rows that share id, label and vector are one row.
Scores beyond 2**62 count as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import hash_sample, q
from barloom.session import stored

#: Factor before components are cut to integers.
SCALE = 256
#: Split points of a node, levels of nodes, and vectors of the sample they come from.
FAN, LEVELS, SAMPLE = 8, 3, 8_192
#: Rows of a block of a leaf, and anchors of a block.
LEAF_ROWS, ANCHORS = 8_192, 2_048
#: Anchors whose scores a task holds at once.
SLICE = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: Window of negative scores in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Scores lie between these.
_LEAST, _MOST = -(1 << 62), 1 << 62
#: Widening of distances against rounding, relative and absolute.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): rows that take part, components as integers."""
    x = F.transform(q(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(q(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * SCALE).cast("double")).alias("v"), fine.alias("fine"))
    return rows.where("id is not null and label is not null and v is not null and fine").drop("fine")


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _long(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(name).to_numpy()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``; in whole numbers where doubles would round."""
    size = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(a.shape[1], 1)
    if size < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


@dataclass
class Tree:
    """Split points per node (vectors of equal length, one component more), the distance ranges of their siblings, and the
    sample."""

    width: int
    length2: float
    nodes: dict[tuple[int, ...], np.ndarray]
    sample: np.ndarray
    labels: np.ndarray
    ranges: dict[tuple[int, ...], np.ndarray] | None = None

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack((v, np.sqrt(np.maximum(self.length2 - (v * v).sum(1), 0))))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, list[tuple[tuple[int, ...], int, np.ndarray]]]:
        """Leaf of each vector; and node, branch and distances to all split points of the vectors that go that way."""
        lifted = self.lift(v)
        leaf = np.full(len(v), "", object)
        ways = []
        pending = [((), np.arange(len(v)))]
        while pending:
            node, rows = pending.pop()
            if node not in self.nodes:
                leaf[rows] = _name(node)
                continue
            d = distances(lifted[rows], self.nodes[node])
            branch = d.argmin(1)
            for k in np.unique(branch).tolist():
                ways.append((node, k, d[branch == k]))
                pending.append(((*node, k), rows[branch == k]))
        return leaf, ways

    def search(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, ...]]:
        """Leaves that may hold a score in one of the ranges ``low`` to ``high`` (inclusive)."""
        norm = float((anchor * anchor).sum()) + self.length2
        point = np.append(anchor, 0.0)[None, :]
        near = np.sqrt(np.maximum(norm - 2 * high, 0))
        far = np.sqrt(np.maximum(norm - 2 * low, 0))
        out, open_nodes = [], [()]
        while open_nodes:
            node = open_nodes.pop()
            if node not in self.nodes:
                out.append(node)
                continue
            d = distances(point, self.nodes[node])[0]
            inner = np.maximum(np.maximum(near[None, :] - d[:, None], d[:, None] - far[None, :]), 0)
            outer = d[:, None] + far[None, :]
            least, most = self.ranges[node][0], self.ranges[node][1]  # (split point, sibling)
            wide = SLACK * (1 + np.sqrt(norm))
            # a sibling stays if for some annulus no split point's range rules it out
            meets = (least[:, :, None] <= (outer + wide)[:, None, :]) & (most[:, :, None] >= (inner - wide)[:, None, :])
            open_nodes += [(*node, int(k)) for k in np.flatnonzero(meets.all(0).any(1))]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _spread(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` distinct points, each the farthest from those before it."""
    chosen = [int(distances(points, points.mean(0, keepdims=True))[:, 0].argmax())]
    nearest = distances(points, points[chosen])[:, 0]
    while len(chosen) < k and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def fit(rows: DataFrame) -> Tree:
    """Split points from about ``SAMPLE`` distinct vectors; distance ranges follow when all vectors are placed."""
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()
    width, length2 = shape[1] or 0, float(shape[2] or 0.0)
    sample = hash_sample(rows, F.hash("label", "v"), SAMPLE, shape[0]).select("label", "v").collect()
    v = np.zeros((len(sample), width))
    for row, r in zip(v, sample):
        row[: len(r["v"])] = r["v"]
    tree = Tree(width, length2, {}, v, np.array([r["label"] for r in sample], np.int64))
    pending = [((), tree.lift(v))] if len(v) else []
    while pending:
        node, points = pending.pop()
        if len(node) == LEVELS or len(points) <= FAN:
            continue
        split = _spread(points, FAN)
        if len(split) < 2:
            continue
        tree.nodes[node] = split
        branch = distances(points, split).argmin(1)
        pending += [((*node, k), points[branch == k]) for k in range(len(split))]
    return tree


def _name(path: tuple[int, ...]) -> str:
    return "/".join(map(str, path))


def _path(name: str) -> tuple[int, ...]:
    return tuple(map(int, name.split("/"))) if name else ()


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` with their ``leaf``."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.StringType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = shared.value.place(_matrix(batch.column("v"), shared.value.width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


_RANGE = "node string, branch int, least array<double>, most array<double>"


def with_ranges(tree: Tree, rows: DataFrame) -> Tree:
    """Distances from every split point to the vectors of every sibling, least and largest over all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for node, branch, d in shared.value.place(_matrix(batch.column("v"), shared.value.width))[1]:
                r = found.setdefault((node, branch), [d[0], d[0]])
                r[0], r[1] = np.minimum(r[0], d.min(0)), np.maximum(r[1], d.max(0))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(n) for n, _ in found]), pa.array([b for _, b in found], pa.int32()), pa.array([list(r[0]) for r in found.values()], pa.list_(pa.float64())), pa.array([list(r[1]) for r in found.values()], pa.list_(pa.float64()))],
                names=["node", "branch", "least", "most"],
            )

    flat = rows.select("v").mapInArrow(run, _RANGE).select("node", "branch", F.posexplode(F.arrays_zip("least", "most")).alias("point", "d"))
    bounds = flat.groupBy("node", "branch", "point").agg(F.min("d.least").alias("least"), F.max("d.most").alias("most")).collect()  # bounded by the tree
    ranges = {n: np.stack((np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf))) for n, p in tree.nodes.items()}
    for b in bounds:
        node = ranges[_path(b["node"])]
        node[0, b["point"], b["branch"]], node[1, b["point"], b["branch"]] = b["least"], b["most"]
    return Tree(tree.width, tree.length2, tree.nodes, tree.sample, tree.labels, ranges)


@dataclass
class Index:
    """All rows (label, v, ids, leaf, salt) by leaf, in blocks of about ``LEAF_ROWS``."""

    tree: Tree
    rows: DataFrame


def _alike(rows: DataFrame, n: int) -> DataFrame:
    """(label, v, ids): the ``n`` smallest ids of each label and vector; the rest is cut before the shuffle."""
    order = W.partitionBy("label", "v").orderBy("id")
    first = rows.distinct().withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= n)
    return first.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def index(rows: DataFrame) -> Index:
    """Tree over ``rows`` (id, label, v)."""
    unique = stored(_alike(rows, POSITIVES + 1))
    fitted = fit(unique)
    inside = stored(placed(unique, fitted))
    tree = with_ranges(fitted, inside)
    sizes = inside.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).alias("blocks"))  # one row per leaf
    return Index(tree, inside.join(F.broadcast(sizes), "leaf").withColumn("salt", F.pmod(F.xxhash64("label", "v"), F.col("blocks"))).drop("blocks"))


def _ragged(column, fill: int) -> np.ndarray:
    """Lists as rows, filled up with ``fill``."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


@dataclass
class _Leaf:
    """A block of a leaf: vectors, labels, and each row's ids as a piece of ``ids``."""

    v: np.ndarray
    labels: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, width: int) -> _Leaf:
        ids = rows.column("ids").combine_chunks()
        return cls(_matrix(rows.column("v"), width), rows.column("label").to_numpy(), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False))

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """Ids of ``rows``, one after the other."""
        counts = self.counts[rows]
        first = (np.cumsum(self.counts) - self.counts)[rows]
        return self.ids[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


def _search(index: Index, queries: DataFrame, bounds, take: int, same: bool) -> DataFrame:
    """Best ``take`` rows per query and range: (query, range, id, score).

    ``queries``: query, block, label, v and what ``bounds(query row, scores of the sample, labels of the sample)`` needs to
    give the ranges.  ``same``: rows of the query's label, else those of others.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.tree)
    carried = [f for f in queries.schema.fields]
    schema = T.StructType([*carried, T.StructField("low", T.ArrayType(T.LongType())), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("leaf", T.StringType())])
    kinds = to_arrow_schema(schema)

    def route(batches) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            v = _matrix(batch.column("v"), tree.width)
            with_sample = scores(v, tree.sample)
            own = _long(batch, "label")
            rest = batch.select([f.name for f in carried]).to_pylist()
            source, low, high, leaf = [], [], [], []
            for i, (row, s) in enumerate(zip(rest, with_sample)):
                lows, highs = bounds(row, s[(tree.labels == own[i]) == same])
                for name in tree.search(v[i], lows.astype(float), highs.astype(float)):
                    source.append(i)
                    low.append(lows.tolist())
                    high.append(highs.tolist())
                    leaf.append(_name(name))
            columns = [c.take(pa.array(source, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, kinds.field(n).type) for n, x in (("low", low), ("high", high), ("leaf", leaf))]], names=schema.fieldNames())

    routed = stored(queries.mapInArrow(route, schema))
    blocks = routed.select("leaf", "block").distinct()  # leaves times blocks of anchors
    leaves = index.rows.join(blocks, "leaf")
    salts = index.rows.select("leaf", "salt").distinct()
    asked = routed.join(salts, "leaf")
    width = index.tree.width

    def best(part: pa.Table, rows: _Leaf) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, range, id, score) of the best rows for some anchors, range by range."""
        table = scores(_matrix(part.column("v"), width), rows.v)
        fits = (part.column("label").to_numpy()[:, None] == rows.labels[None, :]) == same
        query = part.column("query").to_numpy()
        lows, highs = (_ragged(part.column(n), fill) for n, fill in (("low", 1), ("high", 0)))
        for k in range(lows.shape[1]):
            at, row = np.nonzero(fits & (table >= lows[:, k : k + 1]) & (table <= highs[:, k : k + 1]))
            score = np.repeat(table[at, row], rows.counts[row])
            at, ids = np.repeat(at, rows.counts[row]), rows.ids_of(row)
            order = np.lexsort((ids, -score, at))
            at, ids, score = at[order], ids[order], score[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            kept = nth < take
            yield query[at[kept]], np.full(int(kept.sum()), k, np.int32), ids[kept], score[kept]

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))]
        if rows.num_rows and asked.num_rows:
            leaf = _Leaf.of(rows, width)
            for at in range(0, asked.num_rows, SLICE):
                out += best(asked.slice(at, SLICE), leaf)
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query", "range", "id", "score"])

    by = ("leaf", "salt", "block")
    asked = asked.withColumnsRenamed({c: f"at_{c}" for c in by})
    found = leaves.groupBy(*by).cogroup(asked.groupBy(*[f"at_{c}" for c in by])).applyInArrow(scan, "query long, range int, id long, score long")
    order = W.partitionBy("query", "range").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def _best_bound(row: dict, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores from that of the sample's last needed row upwards."""
    need = POSITIVES + 1
    low = np.partition(sample, -need)[-need] if len(sample) >= need else _LEAST
    return np.array([low], np.int64), np.array([_MOST], np.int64)


def window(positive: int) -> tuple[int, int]:
    """Scores n with LOW * positive <= 100 * n <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _window_bounds(row: dict, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A window per positive score, its lower end raised to the sample's last needed row in it."""
    lows, highs = [], []
    for score in row["scores"]:
        low, high = window(score)
        inside = sample[(sample >= low) & (sample <= high)]
        if len(inside) >= NEGATIVES:
            low = int(np.partition(inside, -NEGATIVES)[-NEGATIVES])
        lows.append(low)
        highs.append(high)
    return np.array(lows, np.int64), np.array(highs, np.int64)


def mine(rows: DataFrame, anchor: Column) -> DataFrame:
    """Hard negatives of the rows (id, label, v) for which ``anchor`` holds: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    rows = stored(rows)
    tree = index(rows)
    # anchors that agree in label and vector are one query
    alike = rows.where(anchor).groupBy("label", "v").agg(F.min("id").alias("first"))
    keyed = stored(alike.withColumn("query", F.xxhash64("label", "v", "first")))
    blocks = max(1, -(-keyed.count() // ANCHORS))
    queries = keyed.withColumn("block", F.pmod("query", F.lit(blocks))).drop("first")
    best = stored(_search(tree, queries, _best_bound, POSITIVES + 1, True).select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = best.groupBy("query").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most POSITIVES + 1
    windows = stored(queries.join(wanted, "query"))
    hits = _search(tree, windows, _window_bounds, NEGATIVES, False)
    negatives = hits.join(windows.select("query", "scores"), "query").select("query", F.expr("scores[range]").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    anchors = rows.where(anchor).distinct().join(keyed.select("label", "v", "query"), ["label", "v"]).select(F.col("id").alias("anchor_id"), "query")
    nth = W.partitionBy("anchor_id", "query").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = anchors.join(best, "query").where("positive_id <> anchor_id").withColumn("__n", F.row_number().over(nth)).where(F.col("__n") <= POSITIVES)
    return positives.join(negatives, ["query", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_table(vectors: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings``: every 50th id is an anchor; every 7th id has its label moved on by one."""
    label = F.when(q("vec_id") % 7 == 0, (q("label") + 1) % 10).otherwise(q("label"))
    return mine(integer_vectors(vectors, "vec_id", "embedding", label), F.col("id") % 50 == 0)
