"""Benchmark decontamination by latent semantic retrieval.

1. Weights: inverse document frequency of every benchmark word over all documents.
2. Latent space: a randomised SVD of the TF-IDF passages of the benchmark.  The tasks multiply their passages with a
   random test matrix and back; Spark adds the products per word, and the driver holds word rows of ``RANK`` numbers for
   one block of items, whose words are bounded by ``BLOCK_WORDS``.
3. Candidates: every document is cut into overlapping windows; a window whose latent vector has a cosine of ``COSINE``
   or more with a benchmark passage is a candidate for its item.
4. Check: the longest common subsequence of words with the item around the window.  A large one is a leak; a middle one
   is a paraphrase if the window also holds the item's answer, its last words.

Words that leak into many documents are common ones.  An item with too few rare words to rest on takes its rarest common
words to them, and its windows are candidates by these words alone, whatever their cosine.

Words are lower-cased and stripped of marks at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, q, text_pass

#: Words of a document window and of a benchmark passage; both advance by half of it.
PASSAGE = 64
#: Dimensions of the latent space, extra columns of the random test matrix, and power iterations.
RANK, EXTRA, ITERATIONS = 96, 8, 2
#: Least cosine of a candidate, least common subsequence of a leak and of a paraphrase (shares of the item's words).
COSINE, LEAK, PARAPHRASE = 0.4, 0.7, 0.5
#: Share of the item's rare words that have to occur around the window, in any order.  At least half of a passage that
#: occurs in a text lies in one window, so half of this share of its rare words has to lie in the window itself.
CONTENT = 0.5
#: Share of the item's words that count as its answer, the least of them, and the share of these that has to be there.
ANSWER, ANSWER_WORDS, ANSWER_FOUND = 0.2, 3, 0.8
#: A word in more than this share of the documents is common and weighs nothing, unless its item has too few rare words.
COMMON, LEAST_RARE = 0.05, 3
#: Benchmark words in a block of items; larger benchmarks are searched block by block.
BLOCK_WORDS = 2_000_000
#: Pairs of a window and a passage that a task counts words for at once.
CELLS = 1 << 20
#: Raw words that a task remembers.
REMEMBERED = 200_000

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"


def words_of(text: str | None) -> list[str]:
    """Words (runs of anything but ASCII white space) in lower case without marks at their ends; marks alone drop out."""
    return [w for raw in (text or "").encode("utf-8", "replace").split() if (w := raw.decode("utf-8").strip(_MARKS).lower())]


#: Bytes that are no marks at the end of a word.
_PLAIN = frozenset(c for c in range(128) if chr(c).isalnum())


class Numbers:
    """Numbers of the words of a text: 0 for a word outside the vocabulary, words of marks alone left out.

    Most words are looked up as they stand; those with something else than an ASCII letter or digit at an end are
    stripped of marks, with a bounded memory.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.exact = {w.encode("utf-8", "replace"): n for w, n in vocabulary.items()}
        self.stripped: dict[bytes, int] = {}

    def _strip(self, raw: bytes) -> int:
        n = self.stripped.get(raw)
        if n is None:
            w = raw.decode("utf-8").strip(_MARKS)
            n = self.stripped[raw] = self.exact.get(w.encode("utf-8"), 0) if w else -1
        return n

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.stripped) > REMEMBERED:
            self.stripped.clear()
        words = (text or "").lower().encode("utf-8", "replace").split()
        get, plain, strip = self.exact.get, _PLAIN, self._strip
        a = np.array([n if (n := get(w)) is not None else 0 if w[0] in plain and w[-1] in plain else strip(w) for w in words], np.int32)
        return a[a >= 0] if len(a) and a.min() < 0 else a


@dataclass
class Items:
    """A block of the benchmark: ids, word numbers per item, and the vocabulary (numbers from 1)."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, list[str]]]) -> Items:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32) for _, ws in rows]
        return cls([r[0] for r in rows], words, vocabulary)

    def passages(self) -> list[tuple[int, np.ndarray]]:
        return [(i, ws[a : a + PASSAGE]) for i, ws in enumerate(self.words) for a in _starts(len(ws))]


def _starts(n: int) -> range:
    """First words of the windows of a text of ``n`` words; the last one reaches its end."""
    half = PASSAGE // 2
    return range(0, max(1, n - half), half)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> Iterator[Items]:
    """Items in blocks of about ``BLOCK_WORDS`` words, streamed one partition at a time; items without a word drop out."""
    held, size = [], 0
    for r in benchmark.where(q(id_col).isNotNull()).select(q(id_col).alias("i"), q(text).alias("t")).distinct().toLocalIterator():
        words = words_of(r["t"])
        if words:
            held.append((r["i"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield Items.of(sorted(held))
            held, size = [], 0
    if held:
        yield Items.of(sorted(held))


def document_frequency(docs: DataFrame, items: Items, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and per vocabulary word those that hold it; one pass over all documents."""
    size = len(items.vocabulary) + 1

    def make():
        numbers = Numbers(items.vocabulary)

        def work(batch):
            seen = np.zeros(size, np.int64)
            for body in batch.column(0).to_pylist():
                seen[np.unique(numbers(body))] += 1
            seen[0] = batch.num_rows
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["w", "n"])

        return work

    schema = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("n", T.LongType())])
    total = np.zeros(size, np.int64)
    for r in explode_pass(docs, [q(text).cast("string")], make, schema).groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["w"]] = r["n"]
    return int(total[0]), total


def idf_of(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.maximum(0.01, -np.log(np.minimum(1.0, (frequency + 1) / (documents + 1))))


def weights_of(documents: int, frequency: np.ndarray, items: Items) -> np.ndarray:
    """Weight per word number: the inverse document frequency of rare words, zero for common ones and number 0."""
    idf = idf_of(documents, frequency)
    weight = np.where((frequency + 1) / (documents + 1) <= COMMON, idf, 0.0)
    weight[0] = 0.0
    for words in items.words:
        if np.count_nonzero(weight[np.unique(words)]) < LEAST_RARE:
            weight[words] = idf[words]
    return weight


def _vector(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a passage and their TF-IDF values, of length one."""
    at, n = np.unique(words, return_counts=True)
    v = n * weight[at]
    return at, v / max(1e-12, float(np.linalg.norm(v)))


def randomised_svd(spark, items: Items, weight: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (word number x rank) of the TF-IDF passages of a block."""
    passages = items.passages()
    size = len(weight)
    rank = min(rank, len(passages))
    width = min(rank + EXTRA, size)
    rows = spark.createDataFrame([(p.tobytes(),) for _, p in passages], "words binary").repartition(max(1, min(64, len(passages) // 2000)))
    basis = np.random.default_rng(seed).standard_normal((size, width))
    schema = T.StructType([T.StructField("w", T.IntegerType()), T.StructField("v", T.BinaryType())])
    for _ in range(1 + ITERATIONS):
        test = spark.sparkContext.broadcast(basis)  # size x width numbers, bounded by the block

        def make(test=test):
            def work(batch):
                total: dict[int, np.ndarray] = {}
                for raw in batch.column(0).to_pylist():
                    at, v = _vector(np.frombuffer(raw, np.int32), weight)
                    y = v @ test.value[at]
                    for w, x in zip(at.tolist(), v):
                        total[w] = total.get(w, 0.0) + x * y
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["w", "v"])

            return work

        product = np.zeros((size, width))
        for r in explode_pass(rows, [F.col("words")], make, schema).toLocalIterator():
            product[r["w"]] += np.frombuffer(r["v"], np.float64)
        basis, _ = np.linalg.qr(product)
    gram = np.zeros((width, width))
    for _, p in passages:
        at, v = _vector(p, weight)
        y = v @ basis[at]
        gram += np.outer(y, y)
    values, vectors = np.linalg.eigh(gram)
    return basis @ vectors[:, np.argsort(values)[::-1][:rank]]


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of the places of each word) and ``words``."""
    full = (1 << length) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


@dataclass
class Search:
    """Everything a task needs to find the items of one block in a text."""

    items: Items
    latent: np.ndarray
    rare: np.ndarray
    passages: np.ndarray
    owner: np.ndarray
    idf: np.ndarray

    @classmethod
    def build(cls, docs: DataFrame, items: Items, text: str = "text") -> Search:
        documents, frequency = document_frequency(docs, items, text)
        weight = weights_of(documents, frequency, items)
        return cls.of(items, weight, randomised_svd(docs.sparkSession, items, weight), idf_of(documents, frequency))

    @classmethod
    def of(cls, items: Items, weight: np.ndarray, vectors: np.ndarray, idf: np.ndarray | None = None) -> Search:
        latent = (weight[:, None] * vectors).astype(np.float32)
        queries = np.array([latent[p].sum(axis=0) for _, p in items.passages()], np.float32)
        queries /= np.maximum(1e-12, np.linalg.norm(queries, axis=1, keepdims=True))
        return cls(items, latent, weight > 0, queries, np.array([i for i, _ in items.passages()]), weight if idf is None else idf)

    def __post_init__(self):
        self.masks, self.content, needed, alone = [], [], [], []
        for words in self.items.words:
            masks: dict[int, int] = {}
            for i, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            content, n = np.unique(words[self.rare[words]]), len(words)
            # a leak lacks (1 - LEAK) * n words at most: not more than the test allows if it rests on this many
            least = int(np.ceil((1 - LEAK) / (1 - CONTENT) * n - 1e-9))
            alone.append(len(content) < least)
            if alone[-1]:
                rest = np.setdiff1d(words, content)
                content = np.sort(np.concatenate((content, rest[np.argsort(-self.idf[rest], kind="stable")][: least - len(content)])))
            self.content.append(content)
            needed.append(max(0.0, min(CONTENT * len(content), len(content) - (1 - LEAK) * n - 1e-9)))
        self.sets = [frozenset(c.tolist()) for c in self.content]
        self.needed, self.alone = np.array(needed), np.array(alone)[self.owner]
        self.rare = self.rare.copy()
        self.rare[np.concatenate(self.content)] = True
        # passages by rare word, as one list with the start of each word's part
        pairs = [(w, p) for p, (i, words) in enumerate(self.items.passages()) for w in np.intersect1d(words, self.content[i]).tolist()]
        word, self.holders = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        self.first = np.searchsorted(word, np.arange(len(self.rare) + 1))
        share = self.needed / np.array([len(c) for c in self.content])
        self.wanted = share[self.owner] / 2 * np.bincount(self.holders, minlength=len(self.owner))

    def found(self, ids: np.ndarray) -> dict[int, tuple]:
        """Item number -> (common words, start, end, cosine, answer found) of the best window, for confirmed items.

        A pair of window and passage needs a cosine and enough rare words; the words are counted first, and the cosine is
        taken of the windows that have enough for some passage.
        """
        out: dict[int, tuple] = {}
        at = np.flatnonzero(self.rare[ids])
        if not len(at):
            return out
        n = len(ids)
        start = np.arange(0, max(1, n - PASSAGE // 2), PASSAGE // 2)
        end = np.minimum(start + PASSAGE, n)
        words = ids[at]
        a, b = np.searchsorted(at, start), np.searchsorted(at, end)
        some = np.flatnonzero(b > a)
        step = max(1, CELLS // len(self.owner))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            window, passage = np.nonzero(self._enough(words, a[part], b[part]))
            if not len(window):
                continue
            cosine = self._cosines(words, a[part], b[part], window, passage)
            for k in np.flatnonzero((cosine >= COSINE) | self.alone[passage]).tolist():
                w = part[window[k]]
                self._check(int(self.owner[passage[k]]), ids, int(start[w]), int(end[w]), float(cosine[k]), out)
        return out

    def _cosines(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, window: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Cosine of each pair of a window and a passage in the latent space."""
        own, back = np.unique(window, return_inverse=True)
        vectors = np.array([self.latent[words[a[w] : b[w]]].sum(axis=0) for w in own.tolist()], np.float32)
        vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
        out = np.empty(len(window), np.float32)
        for lo in range(0, len(window), CELLS // 64):
            s = slice(lo, lo + CELLS // 64)
            out[s] = np.einsum("ij,ij->i", vectors[back[s]], self.passages[passage[s]])
        return out

    def _enough(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which passages (columns) have enough of their rare words in each window (rows).

        ``words`` are the rare words of the text, ``a`` and ``b`` the first and the last (exclusive) of each window.
        """
        size, span = len(self.owner), b - a
        window = np.repeat(np.arange(len(span)), span)
        held = words[np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(a, span)]
        window, held = np.divmod(np.unique(window * len(self.rare) + held), len(self.rare))
        count = self.first[held + 1] - self.first[held]
        passage = self.holders[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[held], count)]
        found = np.bincount(np.repeat(window, count) * size + passage, minlength=len(span) * size)
        return found.reshape(len(span), size) >= self.wanted

    def _check(self, item: int, ids: np.ndarray, a: int, b: int, cosine: float, out: dict[int, tuple]) -> None:
        words = self.items.words[item]
        n = len(words)
        lo, hi = max(0, a - n), min(len(ids), b + n)
        near = ids[lo:hi].tolist()
        there = set(near)
        held = len(self.sets[item] & there)
        if held < self.needed[item]:
            return
        common = common_subsequence(self.masks[item], n, near)
        if common < PARAPHRASE * n or (item in out and out[item][0] >= common):
            return
        tail = set(words[-max(ANSWER_WORDS, round(ANSWER * n)) :].tolist())
        answer = len(tail & there) >= ANSWER_FOUND * len(tail)
        if common >= LEAK * n or answer and held >= CONTENT * len(self.sets[item]):
            out[item] = (common, lo, hi, cosine, answer)


_LEAK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("common_words", T.LongType()),
        T.StructField("item_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("cosine", T.DoubleType()), T.StructField("answer_found", T.BooleanType()),
    ]
)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it, with the word range (from 0, end exclusive) that was compared.

    Every window of every text is searched.  Null and empty texts have no row, nor has an item without a word; ids pass
    through, null and repeated ones too; an empty benchmark gives an empty result.
    """
    out = docs.sparkSession.createDataFrame([], _LEAK)
    for items in item_blocks(benchmark):
        search = Search.build(docs, items, text)
        shared = docs.sparkSession.sparkContext.broadcast(search)  # bounded by BLOCK_WORDS

        def make(shared=shared):
            search, numbers = shared.value, Numbers(shared.value.items.vocabulary)

            def work(batch):
                rows = []
                for doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                    for item, (common, a, b, cosine, answer) in sorted(search.found(numbers(body)).items()):
                        rows.append((doc_id, search.items.ids[item], common, len(search.items.words[item]), a, b, cosine, answer))
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_LEAK.fieldNames())

            return work

        out = out.unionByName(explode_pass(docs, [q(id_col).cast("long"), q(text).cast("string")], make, _LEAK))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found; columns are those of ``docs``."""
    out = docs
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Search.build(docs, items, text))

        def make(shared=shared):
            search, numbers = shared.value, Numbers(shared.value.items.vocabulary)
            return lambda texts: [pa.array([not search.found(numbers(t)) for t in texts], pa.bool_())]

        carried = out.select("*", q(text).alias("__copy"))
        out = text_pass(carried, make, [T.StructField("__clean", T.BooleanType())], text="__copy").where("__clean").drop("__clean")
    return out
