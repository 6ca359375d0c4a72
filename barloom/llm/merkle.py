"""Merkle manifest of a table by a tree of SHA-256 midstates.

A leaf is the hash of a row's columns; the rows of a key (a language) form a tree of runs of ``FAN`` consecutive nodes,
and the keys' roots form one tree above.  A parent keeps a copy of its hash state before each child slot, so a changed
child is folded by resuming the state before its slot with the new digest and the siblings to its right alone; nothing to
its left is hashed again.

A tree is worked on in blocks of ``FAN ** DEPTH`` consecutive nodes, each a whole subtree and a group of its own.  Blocks
are built upwards, one node per block, until each key has one; then the way from a block to the root (siblings on both
sides, level by level) is handed down, one row per block.  A block of leaves gets that row, resumes the states above itself
from it, and folds and proves each of its leaves.  No state leaves a task, and no task holds more than a block.

Rows with a null order column come first; rows that share it are ordered by leaf, so equal rows are interchangeable.  A null
key is a tree of its own.  An empty table has no rows and no root.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.ordering import with_global_rank
from barloom.llm.common import q, written
from barloom.session import stored

#: Children of a node, and levels of the subtree that one task holds.
FAN, DEPTH = 8, 4
SPAN = FAN**DEPTH

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    count = 0
    while n > 1:
        n, count = -(-n // FAN), count + 1
    return count


class Block:
    """Subtree over consecutive nodes: per level and child the state before its slot and the siblings on both sides."""

    def __init__(self, digests: list[bytes], depth: int):
        self.states: list[list] = []
        self.before: list[list[bytes]] = []
        self.after: list[list[bytes]] = []
        for _ in range(depth):
            states, before, after, parents = [], [], [], []
            for at in range(0, len(digests), FAN):
                run = digests[at : at + FAN]
                state = sha256()
                for i, child in enumerate(run):
                    states.append(state.copy())
                    before.append(b"".join(run[:i]))
                    after.append(b"".join(run[i + 1 :]))
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.states.append(states)
            self.before.append(before)
            self.after.append(after)
            digests = parents
        self.top = digests

    def way(self, at: int) -> tuple[list[bytes], list[bytes]]:
        """Siblings to the left and to the right of node ``at`` and of its ancestors."""
        left, right = [], []
        for before, after in zip(self.before, self.after):
            left.append(before[at])
            right.append(after[at])
            at //= FAN
        return left, right

    def fold(self, at: int, digest: bytes) -> bytes:
        """Top digest with ``digest`` in the place of node ``at``."""
        for states, after in zip(self.states, self.after):
            state = states[at].copy()
            state.update(digest)
            state.update(after[at])
            digest, at = state.hexdigest().encode(), at // FAN
        return digest


class Way:
    """The levels above a block, resumed from the siblings on its way to the root."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.states, self.right = [sha256(x) for x in left], right
        self.siblings = b"".join(a + b for a, b in zip(left, right))

    def fold(self, digest: bytes) -> bytes:
        for before, after in zip(self.states, self.right):
            state = before.copy()
            state.update(digest)
            state.update(after)
            digest = state.hexdigest().encode()
        return digest


def leaf(columns: list[Column]) -> Column:
    """Hash of the columns: ``-`` for null, else the UTF-8 length in bytes, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]), 256)


_NODE = "key string, pos long, n long, digest string"


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _digests(rows: pa.Table) -> list[bytes]:
    return [x.encode() for x in rows.column("digest").to_pylist()]


def _up(nodes: DataFrame) -> DataFrame:
    """One node per block."""

    def build(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        n, block = rows.column("n")[0].as_py(), rows.column("block")[0].as_py()
        top = Block(_digests(rows), min(DEPTH, levels(n))).top
        return pa.table({"key": rows.column("key")[:1], "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n // SPAN)], pa.int64()), "digest": [top[0].decode()]})

    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("key", "block").applyInArrow(build, _NODE)


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of each block level, the last with one node per key."""
    stages = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        stages.append(stored(_up(stages[-1])))
        if most <= SPAN:
            return stages
        most = -(-most // SPAN)


_WAY = "key string, block long, left array<string>, right array<string>, subroot string, root string"


def _texts(column) -> list[bytes]:
    return [x.encode() for x in column[0].as_py()]


def _down(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Way to the root of each node, from that of its block."""

    def walk(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        block = Block(_digests(rows), min(DEPTH, levels(rows.column("n")[0].as_py())))
        left, right = way.column("left")[0].as_py(), way.column("right")[0].as_py()
        own = [block.way(i) for i in range(rows.num_rows)]
        repeat = lambda name: pa.array(way.column(name).to_pylist() * rows.num_rows, pa.string())
        return pa.table(
            {
                "key": rows.column("key"), "block": rows.column("pos"),
                "left": pa.array([[x.decode() for x in a] + left for a, _ in own], pa.list_(pa.string())),
                "right": pa.array([[x.decode() for x in b] + right for _, b in own], pa.list_(pa.string())),
                "subroot": repeat("subroot"), "root": repeat("root"),
            }
        )

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("key", "block")
    return blocks.cogroup(ways.groupBy("key", "block")).applyInArrow(walk, _WAY)


@dataclass
class Manifest:
    """``leaves`` (key, pos, n, digest and what was kept with them), ``keys`` (key, n, subroot, root) and the ways of the
    leaves' blocks to the root."""

    leaves: DataFrame
    keys: DataFrame
    ways: DataFrame


#: Key of the tree over the keys, and marks of a key's own tree: null keys come first, then keys by their bytes.
_TOP, _NULL, _SET = "", "0", "1"


def manifest(rows: DataFrame, key: Column, order: list[Column], digest: Column, **kept: Column) -> Manifest:
    """Trees over ``rows`` (one leaf a row, written once), a tree per ``key`` in ``order`` and one over the keys.

    ``kept`` columns stay with the leaves.
    """
    tree = F.when(key.isNull(), F.lit(_NULL)).otherwise(F.concat(F.lit(_SET), key.cast("string")))
    flat = written(rows.select(tree.alias("key"), digest.alias("digest"), *[c.alias(f"__o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in kept.items()])).df
    ranked = with_global_rank(flat, [F.col("key").asc(), *[F.col(f"__o{i}").asc_nulls_first() for i in range(len(order))], F.col("digest").asc()], "__rank")
    counts = stored(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    placed = with_global_rank(counts, [F.col("key").asc()], "pos").withColumn("pos", F.col("pos") - 1)
    # the rank of a key's first row follows from the counts of the keys before it
    first = stored(ranked.groupBy("key").agg(F.min("__rank").alias("__first")).join(counts, "key"))
    leaves = stored(ranked.join(first, "key").withColumn("pos", F.col("__rank") - F.col("__first")).select("key", "pos", "n", "digest", *kept))
    stages = _grow(leaves.select("key", "pos", "n", "digest"))
    subroots = stages[-1].select("key", F.col("digest"))
    total = counts.count()
    tops = placed.join(subroots, "key").select(F.lit(_TOP).alias("key"), "pos", F.lit(total).cast("long").alias("n"), "digest", F.col("key").alias("of"))
    tops = stored(tops)
    above = _grow(tops.select("key", "pos", "n", "digest"))
    none = F.array().cast("array<string>")
    ways = above[-1].select("key", F.lit(0).cast("long").alias("block"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        ways = stored(_down(nodes, ways))
    ways = tops.join(ways.select(F.col("block").alias("pos"), "left", "right", "root"), "pos").select(F.col("of").alias("key"), F.lit(0).cast("long").alias("block"), "left", "right", F.col("digest").alias("subroot"), "root")
    keys = counts.join(ways.select("key", "subroot", "root"), "key")
    for nodes in reversed(stages[1:-1]):
        ways = stored(_down(nodes, ways))
    return Manifest(leaves, keys, ways)


def audit(tree: Manifest, now: str, kept: T.StructType) -> DataFrame:
    """Each leaf folded with the digest in column ``now`` (null: unchanged) in its place.

    Returns the ``kept`` columns, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (hash of the siblings on the way to the
    root, level by level and left to right), ``folded_root`` and ``verified`` (the folded root is the root).
    """
    found = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([*kept.fields, *[T.StructField(n, T.StringType()) for n in found], T.StructField("verified", T.BooleanType())])
    names = kept.fieldNames()

    def check(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        digests = _digests(rows)
        block = Block(digests, min(DEPTH, levels(rows.column("n")[0].as_py())))
        above = Way(_texts(way.column("left")), _texts(way.column("right")))
        subroot, root = way.column("subroot")[0].as_py(), way.column("root")[0].as_py()
        proofs, folded = [], []
        for i, (old, new) in enumerate(zip(digests, rows.column(now).to_pylist())):
            left, right = block.way(i)
            siblings = sha256(b"".join(a + b for a, b in zip(left, right)))
            siblings.update(above.siblings)
            proofs.append(siblings.hexdigest())
            folded.append(above.fold(block.fold(i, new.encode() if new else old)).decode())
        columns = [*[rows.column(n) for n in names], rows.column("digest"), pa.array([subroot] * len(digests), pa.string()), pa.array([root] * len(digests), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == root for x in folded], pa.bool_())]
        return pa.table(columns, names=schema.fieldNames())

    blocks = tree.leaves.withColumn("block", F.floor(F.col("pos") / SPAN)).groupBy("key", "block")
    return blocks.cogroup(tree.ways.groupBy("key", "block")).applyInArrow(check, schema)


def tampered(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether the document counts as tampered with, and its text then: A-Z in lower case where 3 divides the id's crc32."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, upper, upper.lower())


def audit_documents(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` by language, audited against the tampered texts of every third document."""
    columns = [q(c) for c in COLUMNS]
    hit, text = tampered(q("doc_id"), q("text"))
    now = F.when(hit, leaf([*columns[:-1], text]))
    tree = manifest(docs, q("lang"), [q("doc_id")], leaf(columns), doc_id=q("doc_id"), now=now)
    return audit(tree, "now", T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
