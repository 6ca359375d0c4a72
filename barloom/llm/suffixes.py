"""Repeated passages by a sparse suffix array over words.

Of every window of ``WINDOW`` consecutive k-grams the position of the smallest k-gram hash is retained, so any shared run
of ``MIN_WORDS`` words holds a retained position, the same one in each copy, within its first ``WINDOW`` words.  The
suffixes at those positions are ordered by their words, block after block (a block of ``BLOCK`` words is compared by its
64-bit hash: any fixed order of the alphabet serves, as only equal beginnings matter), then by document and position.
Suffixes that share a first block with a neighbour are extended to the left and to the right: each run of ``MIN_WORDS``
words around the block that chooses its position is compared, by a 64-bit hash, with those of all suffixes of the block.
Runs that occur twice are repeats, whichever suffixes of the block they are shared with and however the block is dealt
over tasks.  Words of a run that occurs in an earlier place (smaller id, then smaller position) can be removed; what is
left holds the first occurrence.

Both orders are range partitionings down to document and position, so the suffixes of a passage that occurs in a third of
all documents are dealt over many tasks.  The rows at the two ends of each task, and nothing else, meet on the driver.
Words are compared in lower case (A-Z) and split at ASCII white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import explode_pass, q, written
from barloom.session import stored

#: Words of the shortest passage that counts as repeated.
MIN_WORDS = 50
#: Words of the k-grams that choose positions, and k-grams in a window; WINDOW + BLOCK <= MIN_WORDS + 1.
KGRAM, WINDOW = 5, 25
#: Words of a block of the suffix order.
BLOCK = 25
#: Word hashes that a task remembers.
REMEMBERED = 200_000

#: Bits for a word position; a longer text would need more.
POSITION = 28

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 1)
        return h


class WordHashes:
    """64-bit hash per word of a text, with a bounded memory of words."""

    def __init__(self):
        self.known = _Known()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 4096)
                self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE, np.uint64))), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of word runs of one document from prefix sums."""

    def __init__(self, words: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def chosen_positions(rolling: Rolling, n: int) -> np.ndarray:
    """Position of the smallest k-gram of each window, in order of the windows; a tie goes to the leftmost."""
    count = n - KGRAM + 1
    if count >> POSITION:
        raise ValueError(f"a text has more than {1 << POSITION} words")
    if count < WINDOW:
        return np.empty(0, np.int64)
    at = np.arange(count)
    # the hash in the upper bits, the position in the lower ones
    low = rolling.runs(at, at + KGRAM) & np.uint64(_MASK ^ (1 << POSITION) - 1) | at.astype(np.uint64)
    width = 1
    while width * 2 <= WINDOW:  # minima of doubling windows
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = WINDOW - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & np.uint64((1 << POSITION) - 1)).astype(np.int64)


def retained(rolling: Rolling, n: int) -> np.ndarray:
    """Positions chosen by a window, those with a whole block after them."""
    found = np.unique(chosen_positions(rolling, n))
    return found[found + BLOCK <= n]


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _table(schema: T.StructType, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], names=schema.fieldNames())


#: A row is known by its id (a null one comes last) and a hash of its text, so that repeated ids keep apart.
NO_ID = (1 << 63) - 1


def _row(id_col: str, text: str) -> list[Column]:
    return [F.coalesce(q(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(q(text))]


@dataclass
class _Distinct:
    """``rows`` (doc, h, body) with one row per key; ``copies`` (doc, h, n, words) of keys with several, None without any."""

    rows: DataFrame
    copies: DataFrame | None

    def long_copies(self) -> DataFrame:
        """Copies of texts with words enough to be a repeat as a whole."""
        return self.copies.where(F.col("words") >= MIN_WORDS)


def _distinct(docs: DataFrame, id_col: str, text: str) -> _Distinct:
    """Copies of a row (id and text) have the same suffixes, which would pass for repeats of the row in itself.

    Keys are counted; only the texts of repeated keys are dealt out.
    """
    doc, h = _row(id_col, text)
    rows = docs.select(doc.alias("doc"), h.alias("h"), q(text).cast("string").alias("body"))
    several = stored(rows.groupBy("doc", "h").agg(F.count("*").alias("n")).where("n > 1"))
    if several.isEmpty():
        return _Distinct(rows, None)
    firsts = stored(rows.join(several.select("doc", "h"), ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"]))
    words = F.size(F.array_remove(F.split(F.coalesce("body", F.lit("")), r"[ \t-\r]+"), "")).cast("long").alias("words")
    copies = firsts.select("doc", "h", words).join(several, ["doc", "h"]).select("doc", "h", "n", "words")
    return _Distinct(rows.join(several.select("doc", "h"), ["doc", "h"], "left_anti").unionByName(firsts), stored(copies))


_SUFFIX = _schema("b1 long, b2 long, doc long, h long, pos int")


def suffixes(rows: DataFrame) -> DataFrame:
    """(b1, b2, doc, h, pos): hashes of the first two blocks of each retained suffix, its row and word position.

    The last bit of ``b2`` tells whether the text goes on for the whole second block.
    """

    def make():
        hashes, powers = WordHashes(), Powers()

        def work(batch):
            cols: list[list[np.ndarray]] = [[] for _ in _SUFFIX.fields]
            for doc, h, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = hashes(body)
                n = len(words)
                if n < MIN_WORDS:
                    continue
                rolling = Rolling(words, powers)
                at = retained(rolling, n)
                second = at + BLOCK
                whole = (second + BLOCK <= n).astype(np.uint64)
                b2 = rolling.runs(second, np.minimum(second + BLOCK, n)) >> np.uint64(1) << np.uint64(1) | whole
                for c, v in zip(cols, (rolling.runs(at, second).view(np.int64), b2.view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), h, np.int64), at.astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield _table(_SUFFIX, map(np.concatenate, cols))

        return work

    return explode_pass(rows, [F.col("doc"), F.col("h"), F.col("body")], make, _SUFFIX)


_MARKED = _schema("b1 long, b2 long, doc long, h long, pos int, hit boolean, same boolean, earlier boolean, edge int")


def _neighbours(found: DataFrame) -> DataFrame:
    """Suffixes in order with what their neighbours tell: ``hit`` (one has the same first block), ``same`` (both blocks,
    whole), ``earlier`` (so has the one before).  The first and last row of a task carry its number in ``edge``."""
    key = ["b1", "b2", "doc", "h", "pos"]
    placed = found.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # the last row so far, as arrays of one, with its flags toward the row before

        def marked(cols, more):
            """Flags of all rows but the last, and the last one to hold back."""
            b1, b2, doc, h, pos, part, hit, same, earlier = cols
            hit, same = hit.copy(), same.copy()
            alike = b1[1:] == b1[:-1]
            twice = alike & (b2[1:] == b2[:-1]) & (b2[1:] & 1 == 1)
            hit[1:] |= alike
            hit[:-1] |= alike
            same[1:] |= twice
            same[:-1] |= twice
            earlier = earlier.copy()
            earlier[1:] |= twice
            return [b1, b2, doc, h, pos, part, hit, same, earlier]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            none = np.zeros(len(cols[0]), bool)
            cols += [none, none, none]
            if held is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            cols = marked(cols, True)
            edge = np.full(len(cols[0]), -1, np.int32)
            if first and len(edge) > 1:
                edge[0], first = cols[5][0], False
            keep = np.flatnonzero((cols[6] | (edge >= 0))[:-1])
            if len(keep):
                yield _table(_MARKED, [c[keep] for i, c in enumerate(cols) if i != 5] + [edge[keep]])
            held = [c[-1:] for c in cols]
        if held is not None:
            yield _table(_MARKED, [c for i, c in enumerate(held) if i != 5] + [held[5].astype(np.int32)])

    marked = stored(placed.mapInArrow(run, _MARKED))
    edges = sorted(marked.where("edge >= 0").collect(), key=lambda r: (r["b1"], r["b2"], r["doc"], r["h"], r["pos"]))  # two rows per partition
    rows = [r.asDict() for r in edges]
    for a, b in zip(rows, rows[1:]):
        if a["edge"] != b["edge"] and a["b1"] == b["b1"]:
            a["hit"] = b["hit"] = True
            if a["b2"] == b["b2"] and a["b2"] & 1:
                a["same"] = b["same"] = b["earlier"] = True
    mended = marked.sparkSession.createDataFrame([tuple(r[n] for n in _MARKED.fieldNames()) for r in rows if r["hit"]], _MARKED)
    return marked.where("hit and edge < 0").unionByName(mended)


_CONTEXT = _schema("b1 long, doc long, h long, pos int, start int, runs binary")


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow array whose element i holds ``values[offsets[i]:offsets[i + 1]]``, 64-bit numbers, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _extended(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates extended to the left and right: ``runs`` are the hashes of the runs of ``MIN_WORDS`` words that choose
    the candidate's position, the first of which begins at word ``start`` and each other one a word later.

    The position that a run chooses is that of its smallest k-gram among the first ``WINDOW``.  It depends on the run
    alone, so equal runs are found at candidates of one block, and each run of a document at one candidate.
    """
    per_row = hits.groupBy(F.col("doc").alias("__d"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_list(F.struct("pos", "b1"))).alias("__at"))  # bounded by a document's words
    joined = rows.join(per_row, (F.col("doc") == F.col("__d")) & (F.col("h") == F.col("__h")))

    def make():
        hashes, powers = WordHashes(), Powers()

        def work(batch):
            count = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            pos, b1 = (x.to_numpy(zero_copy_only=False) for x in batch.column(3).flatten().flatten())
            starts, sizes, values, at = [], [], [], 0
            for text, n in zip(batch.column(2).to_pylist(), count.tolist()):
                words = hashes(text)
                rolling = Rolling(words, powers)
                chosen = chosen_positions(rolling, len(words))[: len(words) - MIN_WORDS + 1]  # never falls
                own = pos[at : at + n]
                first, after = np.searchsorted(chosen, own, "left"), np.searchsorted(chosen, own, "right")
                run = np.flatnonzero(np.isin(chosen, own))
                starts.append(first)
                sizes.append(after - first)
                values.append(rolling.runs(run, run + MIN_WORDS))
                at += n
            start, size = np.concatenate(starts), np.concatenate(sizes)
            some = size > 0  # at the ends of a text a position is chosen by no run
            doc, h = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), count) for k in (0, 1))
            runs = _binary(np.concatenate(values), np.concatenate(([0], np.cumsum(size[some]))))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in (b1, doc, h, pos, start.astype(np.int32))), runs], names=_CONTEXT.fieldNames())

        return work

    return explode_pass(joined, [F.col("doc"), F.col("h"), F.col("body"), F.col("__at")], make, _CONTEXT)


@dataclass
class _Rows:
    """Candidates as columns; candidate i has the runs ``runs[at[i]:at[i + 1]]``."""

    b1: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    start: np.ndarray
    runs: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        b1, doc, h, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
        size = pc.binary_length(batch.column(5)).to_numpy(zero_copy_only=False) // 8
        return cls(b1, doc, h, start, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64), np.concatenate(([0], np.cumsum(size))))

    def part(self, a: int, b: int) -> _Rows:
        low = self.at[a]
        return _Rows(self.b1[a:b], self.doc[a:b], self.h[a:b], self.start[a:b], self.runs[low : self.at[b]], self.at[a : b + 1] - low)

    @staticmethod
    def join(parts: list[_Rows]) -> _Rows:
        columns = [np.concatenate([getattr(p, n) for p in parts]) for n in ("b1", "doc", "h", "start", "runs")]
        return _Rows(*columns, np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts])))))


#: ``any`` and ``earlier`` as spans; or a ``run`` at word ``start`` that is still to be compared with those of other tasks.
_FOUND = _schema("doc long, h long, any long, earlier long, run long, start int")
#: Runs of one block that a task compares at once; a larger block is compared in parts, as if other tasks held them.
PART = 2_000_000


def _matched(rows: _Rows, whole_blocks: bool) -> Iterator[pa.RecordBatch]:
    """Spans (start << 32 | end; null: none) of candidates, which come in order of their places.

    All runs of a candidate hold its block, so those that occur elsewhere make up one span.  If the rest of their block
    is not at hand, the first occurrence of each run, which alone can be earlier than all others or have an earlier one
    only there, goes on to the order of runs; later ones are settled here.
    """
    if not len(rows.b1):
        return
    order = np.argsort(rows.runs, kind="stable")  # equal runs stay in order of their places
    alike = rows.runs[order[1:]] == rows.runs[order[:-1]]
    early, whole = np.zeros(len(order), bool), np.zeros(len(order), bool)
    early[order[1:][alike]] = True
    whole[order[:-1][alike]] = True
    whole |= early
    owner = np.repeat(np.arange(len(rows.b1)), np.diff(rows.at))
    step = np.arange(len(order)) - rows.at[owner]
    spans = []
    for flag in (whole, early):
        low = np.minimum.reduceat(np.where(flag, step, 1 << 30), rows.at[:-1])
        high = np.maximum.reduceat(np.where(flag, step, -1), rows.at[:-1])
        start = rows.start.astype(np.int64)
        spans.append(((start + low) << 32 | (start + high + MIN_WORDS), high >= 0))
    keep = spans[0][1]
    yield _table(_FOUND, [rows.doc[keep], rows.h[keep], *(pa.array(v[keep], mask=~on[keep]) for v, on in spans), pa.nulls(int(keep.sum()), pa.int64()), pa.nulls(int(keep.sum()), pa.int32())])
    if not whole_blocks:
        first = np.flatnonzero(~early)
        none, of = pa.nulls(len(first), pa.int64()), owner[first]
        yield _table(_FOUND, [rows.doc[of], rows.h[of], none, none, rows.runs[first].view(np.int64), (rows.start[of] + step[first]).astype(np.int32)])


def _spans(contexts: DataFrame) -> DataFrame:
    """(doc, h, any, earlier): spans of runs that occur elsewhere too; ``earlier``: in earlier places.

    Blocks that lie within one task are compared there.  Of the first and the last block of each task, which may go on in
    other tasks, the first occurrences in the task of their runs are put in order of runs, document and position, in
    which equal ones are neighbours; copies of a run within a task cost nothing there.
    """
    key = ["b1", "doc", "h", "pos"]
    placed = contexts.repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches) -> Iterator[pa.RecordBatch]:
        block, held, size, open_ = None, [], 0, True  # the block that has not ended: hash, rows, runs; whether others may hold more
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            ends = int(np.searchsorted(rows.b1, rows.b1[0] if block is None else block, "right"))  # rows that still belong to it
            last = int(np.searchsorted(rows.b1, rows.b1[-1], "left"))
            block = rows.b1[-1]
            held.append(rows.part(0, ends))
            if ends < len(rows.b1):
                yield from _matched(_Rows.join(held), not open_)
                yield from _matched(rows.part(ends, last), True)
                held, size, open_ = [rows.part(last, len(rows.b1))], 0, False
            size += len(held[-1].runs)
            if size > PART:
                yield from _matched(_Rows.join(held), False)
                held, size, open_ = [], 0, True
        if held:
            yield from _matched(_Rows.join(held), False)

    found = stored(placed.mapInArrow(run, _FOUND))
    runs = found.where("run is not null").select(F.col("run").alias("b1"), F.lit(1).cast("long").alias("b2"), "doc", "h", F.col("start").alias("pos"))
    span = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("pos").cast("long") + MIN_WORDS)
    across = _neighbours(runs).select("doc", "h", span.alias("any"), F.when(F.col("earlier"), span).alias("earlier"))
    return found.where("run is null").select("doc", "h", "any", "earlier").unionByName(across)


_SEGMENT = _schema("doc long, h long, start int, end int, removed boolean")


def _segments(distinct: _Distinct) -> DataFrame:
    """(doc, h, start, end, removed): maximal runs of repeated words, each wholly removable or wholly kept.

    ``doc`` and ``h`` name the row (see ``_row``), of copies the first one; positions are word numbers from 0, ``end`` is
    exclusive.  The first of several rows without an id is repeated as a whole; copies with an id are one row.
    """
    found = written(suffixes(distinct.rows))
    hits = _neighbours(found.df)
    found.drop()
    spans = _spans(_extended(distinct.rows, hits))
    if distinct.copies is not None:
        whole = distinct.long_copies().where(F.col("doc") == NO_ID)
        spans = spans.unionByName(whole.select("doc", "h", F.col("words").alias("any"), F.lit(None).cast("long").alias("earlier")))
    grouped = spans.groupBy("doc", "h").agg(F.collect_list("any").alias("any"), F.collect_list("earlier").alias("earlier"))  # bounded by a document's words

    def make():
        def work(batch):
            out: list[list] = [[] for _ in _SEGMENT.fields]
            runs = [(x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))))) for x in batch.columns[2:]]
            for i, (doc, h) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]))):
                own = [v[at[i] : at[i + 1]] for v, at in runs]
                size = int((own[0] & 0xFFFFFFFF).max()) + 1
                cover = []
                for v in own:
                    steps = np.bincount(v >> 32, minlength=size) - np.bincount(v & 0xFFFFFFFF, minlength=size)
                    cover.append(np.cumsum(steps) > 0)
                state = cover[0].astype(np.int8) + cover[1]
                cuts = np.flatnonzero(np.diff(state, prepend=np.int8(0)))
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                    if state[a]:
                        for c, v in zip(out, (doc, h, a, b, bool(state[a] == 2))):
                            c.append(v)
            yield _table(_SEGMENT, out)

        return work

    return explode_pass(grouped, [F.col("doc"), F.col("h"), F.col("any"), F.col("earlier")], make, _SEGMENT)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, removed), one row per maximal run of repeated words.

    ``removed`` runs occur at an earlier place too; the others are first occurrences.  A run may lie next to the other
    kind.  Texts with fewer than ``MIN_WORDS`` words (null ones too) have no row.  Rows that repeat id and text are one
    row; a null id comes after all others and stays null, and rows without an id are documents of their own.
    """
    distinct = _distinct(docs, id_col, text)
    rows = _segments(distinct)
    if distinct.copies is not None:
        later = distinct.long_copies().where(F.col("doc") == NO_ID).select("doc", "h", "words", F.explode(F.sequence(F.lit(2).cast("long"), "n")))
        rows = rows.unionByName(later.select("doc", "h", F.lit(0).alias("start"), F.col("words").cast("int").alias("end"), F.lit(True).alias("removed")))
    return rows.select(F.expr(f"nullif(doc, {NO_ID}L)").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "removed")


def cut_words(text: str, segments: list[tuple[int, int]]) -> str:
    """``text`` without the words of the (sorted, disjoint) segments and the white space after them."""
    raw = text.encode("utf-8", "replace")
    at = [m.start() for m in re.finditer(rb"[^ \t-\r]+", raw)] + [len(raw)]
    out, last = [], 0
    for start, end in segments:
        out.append(raw[last : at[start]])
        last = at[min(end, len(at) - 1)]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out of the text; all rows but those whose whole text goes.

    Texts without a repeated passage are unchanged to the byte.  A row loses its place only if it had a word and every
    word of it occurs in earlier passages.  Of copies (same id or none, same text of ``MIN_WORDS`` words or more) the one
    with the smallest hash of all columns counts as the first.  Columns are those of ``docs``.
    """
    distinct = _distinct(docs, id_col, text)
    removed = _segments(distinct).where("removed")
    cuts = removed.groupBy(F.col("doc").alias("__d"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    doc, h = _row(id_col, text)
    names = [f"__{i}" for i in range(len(docs.columns))]  # any column names may come in
    plain = docs.select(*[q(c).alias(n) for c, n in zip(docs.columns, names)], doc.alias("__doc"), h.alias("__hash"))
    if distinct.copies is not None:
        copied = distinct.long_copies().select(F.col("doc").alias("__doc"), F.col("h").alias("__hash"))
        first = F.min_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*names)))).alias("__row")
        firsts = plain.join(copied, ["__doc", "__hash"], "left_semi").groupBy("__doc", "__hash").agg(first)
        plain = plain.join(copied, ["__doc", "__hash"], "left_anti").unionByName(firsts.select("__row.*", "__doc", "__hash"))
    joined = plain.join(cuts, (F.col("__doc") == F.col("__d")) & (F.col("__hash") == F.col("__h")), "left").select(*names, "__cuts")
    place = docs.columns.index(text)
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("__left", T.BooleanType())])

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            left = [True] * len(texts)
            for i, x in enumerate(lists):
                if x:
                    texts[i] = cut_words(texts[i], [(s["start"], s["end"]) for s in x])
                    left[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left)], names=schema.fieldNames())

    return joined.mapInArrow(run, schema).where("__left").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
