"""Repeated word runs by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id.  Documents are cut into phrases at content-chosen
positions: a window of ``WINDOW`` words belongs to the phrase of its smallest ``KGRAM``-word hash, so equal windows, in
whatever documents, lie in phrases with the same hash.  The reference is dealt into blocks by that hash.  Each phrase thus
meets the one block that can hold any of its windows, which is the parse against every block without the visits that could
find nothing.

A block keeps its phrases in document order and indexes where each window occurs first.  A phrase is parsed greedily: its
next window is looked up; found in a smaller document, the factor is extended along that reference phrase as far as the
words agree; at the factor's end the parse goes on with the window that straddles the boundary, which may have another
reference; a window without reference is a literal and the parse moves by one word.  A factor covers at least ``WINDOW``
words; the union of a document's factors is removed.

Phrases travel as hashes of their windows (48 bits, besides the 64 of the phrase), the texts only once, to be cut.  Hashes
that begin a large share of the phrases of a bounded sample (``frequent``) are dealt window by window and not phrase by
phrase, and a task sends a window of theirs again only for a smaller document: a passage in a third of all documents is as
many rows as there are tasks.  The sample decides where windows meet, never whether they are found.

Rows without an id are no reference and are parsed against all others; rows that share an id are no reference for each
other; repeated rows get equal results.  A null text has no words.  Ids must be below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import explode_pass, hash_sample, q
from barloom.llm.suffixes import Powers, Rolling
from barloom.session import stored

#: Words of a window, the shortest factor, and of the hashes that cut phrases.
WINDOW, KGRAM = 13, 4
#: k-grams of a window; phrases hold up to this many windows.
REACH = WINDOW - KGRAM + 1
#: Words that are hashed at once; a longer text is read in pieces that overlap by a window.
PIECE = 1 << 18
#: Bits of a position in a piece, and of a window's hash.
POSITION, BITS = 19, 48
#: Rows of a block that are indexed at once, below 2**16.
ROWS = 60_000
#: Documents of the sample that finds frequent phrase hashes, and the share from which one counts as frequent.
SAMPLE_DOCS, SHARE = 20_000, 1 / 5_000
#: Words, and windows of frequent phrases, that a task remembers.
REMEMBERED = 100_000

#: Rows without an id are known by their text, above all ids.
NO_ID = 1 << 62

_PHRASE = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("h", T.LongType()), T.StructField("at", T.LongType()), T.StructField("windows", T.BinaryType())]
)
_FACTOR = T.StructType(_PHRASE.fields[1:4])


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "replace").split()


def _pieces(batch: pa.RecordBatch, known: _Known) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Word hashes of up to ``PIECE`` words, with (row, first word, words) of each text or part of a text in them."""
    parts, where, held = [], [], 0
    for row, text in enumerate(batch.column(2).to_pylist()):
        words = words_of(text)
        at = 0
        while len(words) - at >= WINDOW:
            take = words[at : at + PIECE - held]
            if len(take) >= WINDOW:
                if len(known) > REMEMBERED:
                    known.clear()
                parts.append(np.fromiter(map(known.__getitem__, take), np.uint64, len(take)))
                where.append((row, at, len(take)))
                held += len(take)
                at += len(take) - WINDOW + 1
            if len(words) - at >= WINDOW or PIECE - held < WINDOW:
                yield np.concatenate(parts), where
                parts, where, held = [], [], 0
    if parts:
        yield np.concatenate(parts), where


def _phrases(words: np.ndarray, where: list[tuple[int, int, int]], powers: Powers) -> tuple[np.ndarray, ...]:
    """key, index into ``where``, first word, windows per phrase, and the windows' hashes."""
    sizes = np.array([n for _, _, n in where])
    base = np.cumsum(sizes) - sizes
    rolling, owner = Rolling(words, powers), np.repeat(np.arange(len(where)), sizes)
    at = np.arange(len(words) - KGRAM + 1)
    grams = rolling.runs(at, at + KGRAM)
    mask = np.uint64((1 << POSITION) - 1)
    low = grams & ~mask | at.astype(np.uint64)  # a tie goes to the leftmost
    width = 1
    while width * 2 <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if REACH > width:
        low = np.minimum(low[: width - REACH], low[REACH - width :])
    whole = np.flatnonzero(owner[: len(low)] == owner[WINDOW - 1 :])
    anchor = (low[whole] & mask).astype(np.int64)
    begins = np.ones(len(whole), bool)
    begins[1:] = (np.diff(whole) != 1) | (np.diff(anchor) != 0)
    first = np.flatnonzero(begins)
    counts = np.diff(np.append(first, len(whole)))
    hashes = rolling.runs(whole, whole + WINDOW) & np.uint64((1 << BITS) - 1)
    own = owner[whole[first]]
    return grams[anchor[first]].view(np.int64), own, whole[first] - base[own], counts, hashes


def _packed(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Six bytes per window, one value per phrase."""
    data = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    offsets = np.concatenate(([0], np.cumsum(counts) * (BITS // 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : BITS // 8] = raw
    return out.view("<u8").reshape(-1)


def _mixed(key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (key.view(np.uint64) ^ hashes) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


class _Seen:
    """Smallest document per window of frequent phrases, as far as a bounded memory goes."""

    def __init__(self):
        self.docs: dict[int, int] = {}

    def known(self, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a smaller document of this task has sent the window."""
        unique, inverse = np.unique(key, return_inverse=True)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, doc)
        if len(self.docs) + len(unique) > REMEMBERED:
            self.docs.clear()
        for i, (k, d) in enumerate(zip(unique.tolist(), least.tolist())):
            before = self.docs.get(k, d)
            self.docs[k] = least[i] = min(before, d)
        return np.minimum(least[inverse], NO_ID) < np.minimum(doc, NO_ID)


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc (the id), h (hash of the text where the id alone does not tell rows apart, else 0), body and the other columns."""
    rows = docs.withColumns({"__id": q(id_col).cast("long"), "__body": q(text).cast("string")})
    several = stored(rows.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    same = F.xxhash64("__body")
    if several.isEmpty():
        rows = rows.withColumn("__h", F.when(F.col("__id").isNull(), same).otherwise(F.lit(0).cast("long")))
    else:
        rows = rows.join(several, "__id", "left").withColumn("__h", F.when(F.col("__id").isNull() | F.col("__n").isNotNull(), same).otherwise(F.lit(0).cast("long"))).drop("__n")
    known = F.when(F.col("__id") < NO_ID, F.col("__id")).when(F.col("__id").isNull(), F.lit(NO_ID) + F.shiftrightunsigned(same, 2))
    return rows.withColumn("__doc", F.coalesce(known, F.raise_error(F.lit("ids must be below 2**62")).cast("long"))).drop("__id")


def frequent(rows: DataFrame) -> np.ndarray:
    """Phrase hashes with at least ``SHARE`` of the phrases of a sample of about ``SAMPLE_DOCS`` documents; at most 1/SHARE."""

    def make():
        known, powers = _Known(), Powers()

        def work(batch):
            for words, where in _pieces(batch, known):
                yield pa.RecordBatch.from_arrays([pa.array(_phrases(words, where, powers)[0])], names=["key"])

        return work

    sample = hash_sample(rows, F.col("__doc"), SAMPLE_DOCS, rows.count())
    keys = stored(explode_pass(sample, [F.col("__doc"), F.col("__h"), F.col("__body")], make, T.StructType(_PHRASE.fields[:1])).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r[0] for r in keys.where(F.col("n") >= max(2, SHARE * total)).select("key").collect()], np.int64))


def phrases(rows: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(key, doc, h, at, windows): phrases for their blocks; ``at`` is the first word and the windows, ``windows`` is null
    for a factor that the task has found itself."""
    names = _PHRASE.fieldNames()

    def make():
        known, powers, seen = _Known(), Powers(), _Seen()

        def work(batch):
            docs, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for words, where in _pieces(batch, known):
                key, own, start, counts, hashes = _phrases(words, where, powers)
                row, offset = (np.array(x, np.int64) for x in list(zip(*where))[:2])
                start, row = start + offset[own], row[own]
                often = np.isin(key, heavy)
                wide = np.repeat(often, counts)
                plain = ~often
                yield pa.RecordBatch.from_arrays([pa.array(key[plain]), pa.array(docs[row[plain]]), pa.array(tags[row[plain]]), pa.array(start[plain] << 4 | counts[plain]), _packed(hashes[~wide], counts[plain])], names=names)
                if not wide.any():
                    continue
                step = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                one = (np.repeat(start, counts) + step)[wide]
                owner, single = np.repeat(row, counts)[wide], hashes[wide]
                key = _mixed(np.repeat(key, counts)[wide], single)
                doc, tag = docs[owner], tags[owner]
                found = seen.known(key, doc)
                sent = ~found
                yield pa.RecordBatch.from_arrays([pa.array(key[sent]), pa.array(doc[sent]), pa.array(tag[sent]), pa.array(one[sent] << 4 | 1), _packed(single[sent], np.ones(int(sent.sum()), np.int64))], names=names)
                # runs of found windows are factors already; they need no block
                at, owner = one[found], owner[found]
                begins = np.ones(len(at), bool)
                begins[1:] = (np.diff(at) != 1) | (np.diff(owner) != 0)
                first = np.flatnonzero(begins)
                run = np.diff(np.append(first, len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(docs[owner[first]]), pa.array(docs[owner[first]]), pa.array(tags[owner[first]]), pa.array(at[first] << 32 | run), pa.nulls(len(first), pa.binary())], names=names)

        return work

    return explode_pass(rows, [F.col("__doc"), F.col("__h"), F.col("__body")], make, _PHRASE)


class _Block:
    """Phrases of a block in order of key and document, indexed by the first place of each window."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, counts: np.ndarray, hashes: np.ndarray):
        runs = np.cumsum(np.append(0, np.diff(key) != 0))
        self.rank, self.counts = np.minimum(doc, NO_ID), counts
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        self.row = np.repeat(np.arange(len(key)), counts)
        self.window = runs[self.row].astype(np.uint64) << np.uint64(BITS) | hashes
        order = np.argsort(self.window, kind="stable")
        ordered = self.window[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
        self.index, self.place = ordered[heads], order[heads]

    def parse(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors of the phrases ``rows``: phrase, first window and windows."""
        out: list[tuple[np.ndarray, ...]] = []
        cursor = self.begin[rows]
        while len(rows):
            reference = self.place[np.searchsorted(self.index, self.window[cursor])]
            other = self.row[reference]
            hit = self.rank[other] < self.rank[rows]
            length = hit.astype(np.int64)
            growing = np.flatnonzero(hit)
            while len(growing):
                here, there = cursor[growing] + length[growing], reference[growing] + length[growing]
                inside = (here < self.end[rows[growing]]) & (there < self.end[other[growing]])
                growing, here, there = growing[inside], here[inside], there[inside]
                growing = growing[self.window[here] == self.window[there]]
                length[growing] += 1
            out.append((rows[hit], (cursor - self.begin[rows])[hit], length[hit]))
            cursor = cursor + np.maximum(length, 1)
            going = cursor < self.end[rows]
            rows, cursor = rows[going], cursor[going]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def first_seen(self) -> np.ndarray:
        """Phrases that hold the first place of a window."""
        return np.unique(self.row[self.place])


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of a block's phrases; the phrases come in order of key, document and position."""
    names = _FACTOR.fieldNames()
    held: list[pa.RecordBatch] = []
    referenced = None  # phrases of the last key that later ones may refer to

    def done(rows: pa.Table):
        nonlocal referenced
        past = referenced.num_rows if referenced is not None else 0
        table = pa.concat_tables([referenced, rows]).combine_chunks() if past else rows
        key, doc, h, at = (table.column(i).to_numpy() for i in range(4))
        block = _Block(key, doc, at & 15, _unpacked(table.column(4)))
        row, first, length = block.parse(np.arange(past, len(key)))
        kept = block.first_seen()
        referenced = table.take(pa.array(kept[key[kept] == key[-1]]))
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(h[row]), pa.array(((at[row] >> 4) + first) << 32 | length)], names=names)

    for batch in batches:
        known = batch.column(4).is_null()
        ready, rest = batch.filter(known), batch.filter(pc.invert(known))
        if ready.num_rows:
            yield ready.select(names)
        for at in range(0, rest.num_rows, ROWS // 4):
            held.append(rest.slice(at, ROWS // 4))
            if sum(x.num_rows for x in held) >= ROWS // 2:
                yield done(pa.Table.from_batches(held))
                held = []
    if any(x.num_rows for x in held):
        yield done(pa.Table.from_batches(held))


def factors(rows: DataFrame) -> DataFrame:
    """(doc, h, at): first word of a factor in the upper 32 bits and its windows in the lower."""
    sent = phrases(rows, frequent(rows))
    return sent.repartition(F.col("key")).sortWithinPartitions("key", "doc", "at").mapInArrow(_parsed, _FACTOR)


def covered(n: int, at: list[int] | None) -> np.ndarray:
    """Which of ``n`` words the factors cover."""
    if not at:
        return np.zeros(n, bool)
    at = np.array(at, np.int64)
    edge = np.zeros(n + 1, np.int64)
    first = at >> 32
    np.add.at(edge, first, 1)
    np.add.at(edge, first + (at & 0xFFFFFFFF) + WINDOW - 1, -1)
    return np.cumsum(edge[:n]) > 0


def _squeezed(rows: DataFrame) -> DataFrame:
    """The last column, texts, as compressed UTF-8: they are moved once, to be cut."""
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(rows.columns[-1], T.BinaryType())])

    def run(batches):
        close_text = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [close_text((x or "").encode("utf-8", "replace")) for x in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


_CUT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (the words left, joined by one space) in place of the text.

    Columns of these names are replaced.
    """
    rows = _rows(docs, id_col, text)
    keep = [c for c in docs.columns if c not in (text, *[f.name for f in _CUT])]
    found = factors(rows).groupBy(F.col("doc").alias("__doc"), F.col("h").alias("__h")).agg(F.collect_list("at").alias("__at"))  # bounded by a document's words
    packed = _squeezed(rows.select(*[q(c).alias(f"__{i}") for i, c in enumerate(keep)], "__doc", "__h", "__body"))
    joined = packed.join(found, ["__doc", "__h"], "left").select(*[f"__{i}" for i in range(len(keep))], "__body", "__at")
    schema = T.StructType([*joined.schema.fields[: len(keep)], *_CUT])
    kinds = [f.type for f in to_arrow_schema(T.StructType(_CUT))]

    def cut(batches):
        open_text = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, left = [], [], []
            for body, at in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                words = open_text(body).split()
                gone = covered(len(words), at)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(x, k) for x, k in zip((sizes, removed, left), kinds)]], names=schema.fieldNames())

    return joined.mapInArrow(cut, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in _CUT])
