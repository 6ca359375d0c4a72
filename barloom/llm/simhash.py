"""SimHash near-duplicates: fingerprints linked at a small Hamming distance, found through vantage-point trees.

The tree is fitted on a bounded sample of the distinct fingerprints.  At a node with vantage point ``v`` and radius
``r`` a fingerprint ``x`` goes inside when d(x, v) <= r and outside when d(x, v) > r - k, where ``k`` is the linking
distance.  If two fingerprints lie within ``k`` and one of them is outside, the triangle inequality puts the other one
outside as well; if neither is, both are inside.  So every linked pair meets in at least one shard, and only
fingerprints in a band of ``k`` below a radius are held by two shards.  Each shard is split further by the same rule in
its task and sends out the edges of a spanning forest, never all pairs.

Copies with one fingerprint are a single node, so a group of exact copies of any size costs nothing beyond its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, q, text_pass, top_rows
from barloom.session import stored

#: Bits in which two linked fingerprints may differ.
DISTANCE = 2
#: Words in a shingle.
SHINGLE = 3
#: Most fingerprints in the sample that the tree is fitted on (8 bytes each), and sample points a leaf needs at least.
SAMPLE, LEAF_SAMPLE = 1 << 17, 16
#: Fingerprints that a shard should hold, and those compared directly inside a task.
SHARD, BLOCK = 4096, 384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 values of word shingles, repeats included; 0 without a word.

    A-Z are lower-cased and words are runs of anything but ASCII white space; a text with fewer words than a shingle
    counts as one shingle.  A bit is set if it is set in over half of the values.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return _majority(np.array(values, np.uint64))


def _majority(values: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(values)).tolist()))


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``__fp`` (the 64 bits as a signed long)."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return text_pass(docs, make, [T.StructField("__fp", T.LongType())], text=text, keep=keep)


@dataclass
class Node:
    """A split (vantage point, radius, children), or a leaf with its shard number."""

    vantage: np.uint64 = np.uint64(0)
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point (of a few, the one with the widest spread), radius and distances; None if nothing is gained."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = np.bitwise_count(points ^ v)
        if best is None or d.std() > best[2].std():
            best = (v, 0, d)
    v, _, d = best
    radius, least = 0, len(points)
    for r in range(int(d.min()), int(d.max())):
        worst = max(int((d <= r).sum()), int((d > r - DISTANCE).sum()))
        if worst < least:
            radius, least = r, worst
    return (v, radius, d) if least <= 0.9 * len(points) else None


def fit_tree(sample: np.ndarray, total: int, shard: int = SHARD, leaf_sample: int = LEAF_SAMPLE) -> tuple[Node, int]:
    """Tree whose leaves hold about ``shard`` of ``total`` fingerprints each, and the number of leaves."""
    rng, leaves = np.random.default_rng(7), 0
    weight = total / max(1, len(sample))

    def grow(points: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        cut = _split(points, rng) if len(points) * weight > shard and len(points) >= 2 * leaf_sample and depth < 60 else None
        if cut is None:
            leaves += 1
            return Node(shard=leaves - 1)
        v, r, d = cut
        return Node(v, r, grow(points[d <= r], depth + 1), grow(points[d > r - DISTANCE], depth + 1))

    return grow(sample, 0), leaves


def shards_of(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for every shard that a point belongs to."""
    shards, rows = [], []
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node.inside is None:
            shards.append(np.full(len(at), node.shard, np.int32))
            rows.append(at)
            continue
        d = np.bitwise_count(points[at] ^ node.vantage).astype(np.int16)
        todo += [(node.inside, at[d <= node.radius]), (node.outside, at[d > node.radius - DISTANCE])]
    return (np.concatenate(shards), np.concatenate(rows)) if rows else (np.empty(0, np.int32), np.empty(0, np.int64))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _block_forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    label, rows = np.arange(n), max(1, (1 << 20) // n)
    for at in range(0, n, rows):
        i, j = np.nonzero(np.bitwise_count(points[at : at + rows, None] ^ points[None, at:]) <= DISTANCE)
        later = j > i
        label = _merge(label, i[later] + at, j[later] + at)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, index) of which the components are those of all links among distinct ``points``."""
    rng, found = np.random.default_rng(11), []
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        cut = _split(points[at], rng) if len(at) > BLOCK else None
        if cut is None:
            if len(at) > 1:
                a, b = _block_forest(points[at])
                found.append((at[a], at[b]))
            continue
        _, r, d = cut
        d = d.astype(np.int16)
        todo += [at[d <= r], at[d > r - DISTANCE]]
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]) if found else empty for k in (0, 1))


def _edges(nodes: DataFrame) -> DataFrame:
    """(a, b) with a > b, node ids of linked fingerprints; ``nodes`` has fp (distinct) and id (distinct)."""
    total = nodes.count()
    bound = min(SAMPLE, max(1024, total // 32))
    rows = top_rows(nodes.select("fp"), [F.xxhash64("fp"), F.col("fp")], bound).toPandas()  # at most SAMPLE rows of 8 bytes
    sample = rows["fp"].to_numpy(np.int64).view(np.uint64) if len(rows) else np.empty(0, np.uint64)
    tree, leaves = fit_tree(sample, total) if total else (Node(shard=0), 1)

    def make():
        def work(batch):
            fp, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            shard, row = shards_of(tree, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row]), pa.array(ids[row])], names=["shard", "fp", "id"])

        return work

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("id", T.LongType())])
    placed = explode_pass(nodes, [F.col("fp"), F.col("id")], make, schema)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        x, y = forest(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": np.maximum(ids[x], ids[y]), "b": np.minimum(ids[x], ids[y])})

    return placed.groupBy("shard").applyInPandas(link, "a long, b long").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a > b) but the roots; a root is the smallest id of its component.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds logarithmic in the
    size of a component; each round is written to the checkpoint folder.
    """
    edges, before = stored(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        near = large.join(low, large["a"] == low["k"])
        small = near.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    ``component_id`` is the smallest doc_id that links reach.  Rows that share an id are one document: each keeps its
    own fingerprint, and these are linked.  Rows with a null id get a fingerprint and, if a row with an id has the same one, its component
    (else null), but link nothing.  A null text is an empty one; texts without a word have fingerprint zero.
    """
    prints = stored(with_fingerprints(docs.select(q(id_col).cast("long").alias("doc_id"), q(text).alias("text")), keep=["doc_id"]))
    named = prints.where("doc_id is not null")
    nodes = stored(named.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("id")))
    # an id with several texts ties their fingerprints together
    several = named.groupBy("doc_id").agg(F.min("__fp").alias("x"), F.max("__fp").alias("y")).where("x <> y").select("doc_id")
    tied = named.join(several, "doc_id", "left_semi").join(nodes, F.col("__fp") == F.col("fp")).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a > b")
    edges = _edges(nodes).unionByName(tied)
    roots = star_components(edges)
    lookup = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(lookup, prints["__fp"] == lookup["fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without the documents that have a near duplicate with a smaller id.

    Rows that share an id stay or go together; rows with a null id stay.  Columns are those of ``docs``.
    """
    found = near_duplicates(docs, id_col, text).where("component_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(found, q(id_col).cast("long") == F.col("__dropped"), "left_anti")
