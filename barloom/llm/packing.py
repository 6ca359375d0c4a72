"""Packing for training sequences: vector bin packing by the dot-product heuristic.

An example demands tokens, one segment and loss-bearing tokens.  A bin has limits on all three.  The next example of a
bin is the one that fits and whose demand has the largest dot product with what the bin has left, both as shares of the
limits; so an example that uses much of what is plentiful is preferred.  When nothing fits whole, the example with the
largest product is cut at what the bin has left and its rest goes back to the pool.

Every task packs the examples of its own input split, in pools of bounded size, so nothing is shuffled and a retried
task gives the same sequences.  What the last pool of a task leaves open is cut into sequences whose length is a power
of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import SLICE, q, release_memory

#: Words whose ids a task remembers, raw ones and bare ones; a memory is emptied when it is full.
REMEMBERED = 300_000
#: Examples that a pool holds before bins are filled from it.
POOL = 2048

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("loss_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class _Words(dict):
    """Ids (little-endian unsigned 32-bit) by raw word, computed when a word is first asked for."""

    # Latin-1 letters, then closing ASCII marks other than those of contractions and special tokens
    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.cores = self.tokenizer.model.tokenize, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _core(self, piece: str) -> bytes:
        ids = self.cores.get(piece)
        if ids is None:
            mapped = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.bytes)
            ids = self.cores[piece] = _packed([t.id for t in self.tokenize(mapped)])
        return ids

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        m = self._PLAIN.fullmatch(word)
        if m is None:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            body, marks = m.groups()
            ids = self._core(body.lower())
            if marks:
                ids += self._core(marks)
        self[raw] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokens:
    """Ids of a text by a tokenizer that never joins across white space, word by word with a bounded memory.

    A plain word (Latin-1 letters with closing marks) is encoded by the model alone, after the lower-casing and byte
    mapping that the tokenizer's own normaliser would do; every other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.known = _Words(path)

    def ids(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if len(known.cores) > REMEMBERED:
            known.cores.clear()
        return np.frombuffer(b"".join(map(known.__getitem__, text.encode("utf-8", "replace").split())), "<u4")


def _loss(start: int, length: int, prompt: int) -> int:
    """Loss-bearing ids of a piece: those after the prompt and after the document's first id."""
    return max(0, start + length - max(start, prompt, 1))


class Packer:
    """Fills sequences from a stream of documents; ``rows`` collects (doc_id, start, length, doc_tokens, seq, offset, loss, ids)."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.sequence, self.pool = limits, first, []
        self.full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0) -> Iterator[tuple]:
        lim, at, total = self.limits, 0, len(ids)
        while total - at > lim.tokens and _loss(at, lim.tokens, prompt) <= lim.loss and lim.segments > 0:
            yield self._row(doc_id, at, ids[at : at + lim.tokens], total, prompt, self.sequence, 0)
            self.sequence, at = self.sequence + 1, at + lim.tokens
        self.pool.append((doc_id, at, ids[at:], total, prompt))
        if len(self.pool) >= POOL:
            yield from self._fill(POOL // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self._fill(0)

    @staticmethod
    def _row(doc_id, start, ids, total, prompt, sequence, offset):
        return (doc_id, start, len(ids), total, sequence, offset, _loss(start, len(ids), prompt), ids.tobytes())

    def _demand(self, item) -> tuple[float, float, float]:
        return len(item[2]), 1, _loss(item[1], len(item[2]), item[4])

    def _fill(self, leave: int) -> Iterator[tuple]:
        """Fill bins until at most ``leave`` examples wait, or none does if that is 0."""
        items = self.pool
        demand = np.array([self._demand(x) for x in items], np.float64).reshape(-1, 3)
        share = demand / self.full
        alive = np.ones(len(items), bool)
        waiting = len(items)
        while waiting > leave:
            chosen, left = [], self.full.copy()
            while waiting and left[0] > 0 and left[1] > 0:
                gain = np.where(alive, share @ (left / self.full), -1.0)
                fits = (demand <= left).all(axis=1)
                best = int(np.where(fits, gain, -1.0).argmax())
                if alive[best] and fits[best]:
                    chosen.append(items[best])
                    left -= demand[best]
                    alive[best] = False
                    waiting -= 1
                    continue
                best = int(gain.argmax())
                doc_id, start, ids, total, prompt = items[best]
                cut = self._cut(start, len(ids), prompt, left)
                if not cut:
                    break
                piece = (doc_id, start, ids[:cut], total, prompt)
                chosen.append(piece)
                left -= self._demand(piece)
                items[best] = (doc_id, start + cut, ids[cut:], total, prompt)
                demand[best] = self._demand(items[best])
                share[best] = demand[best] / self.full
            if not chosen:
                raise ValueError("the limits leave no room for a single token")
            yield from self._emit(chosen)
        self.pool = [x for x, on in zip(items, alive) if on]

    @staticmethod
    def _cut(start: int, length: int, prompt: int, left: np.ndarray) -> int:
        """Ids of an example that still fit: as many as tokens are left and loss-bearing ids are left."""
        free = max(0, max(prompt, 1) - start)
        return int(min(length, left[0], free + left[2]))

    def _emit(self, chosen: list[tuple]) -> Iterator[tuple]:
        """Rows of one bin; a bin that is not full is cut into sequences of a power of two."""
        room, used = [], sum(len(x[2]) for x in chosen)
        if used == self.limits.tokens:
            room = [used]
        else:
            room = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        offset = 0
        for doc_id, start, ids, total, prompt in chosen:
            while len(ids):
                take = min(len(ids), room[0] - offset)
                yield self._row(doc_id, start, ids[:take], total, prompt, self.sequence, offset)
                start, ids, offset = start + take, ids[take:], offset + take
                if offset == room[0]:
                    room.pop(0)
                    self.sequence, offset = self.sequence + 1, 0


def pack(
    docs: DataFrame, tokenizer: str, *, end_id: int = 2, limits: Limits | None = None, id_col: str = "doc_id", text: str = "text", prompt: str | None = None
) -> DataFrame:
    """Pieces of all rows of ``docs`` in sequences, with their ids (little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a tokenizer file that every executor can read.  A document's ids are those of its text
    followed by ``end_id``; a null or empty text has ``end_id`` alone.  ``prompt`` names a text column put before the
    text whose ids bear no loss (null: none), for instruction data.  Null and repeated ids are packed like any others;
    an empty table gives no piece.
    """
    limits = limits or Limits()
    source = docs.select(q(id_col).cast("long"), q(text).cast("string"), (q(prompt).cast("string") if prompt else F.lit(None).cast("string")), F.spark_partition_id())
    names = [f"c{i}" for i in range(4)]

    def run(batches):
        words, packer = WordTokens(tokenizer), None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                doc_ids, texts, prompts, where = (c.to_pylist() for c in part.columns)
                packer = packer or Packer(limits, where[0] << 36)
                rows = []
                for doc_id, body, head in zip(doc_ids, texts, prompts):
                    lead = words.ids(head) if head else np.empty(0, "<u4")
                    ids = np.concatenate((lead, words.ids(body or ""), np.array([end_id], "<u4"))).astype("<u4")
                    rows += packer.add(doc_id, ids, len(lead))
                yield from _batches(rows)
        if packer:
            yield from _batches(list(packer.finish()))
        del words, packer
        release_memory()

    return source.toDF(*names).mapInArrow(run, PIECE)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=PIECE.fieldNames())
