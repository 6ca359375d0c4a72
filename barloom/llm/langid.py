"""Language identification, word first: known words score by their log frequency per language, unseen words back off
to character n-grams, longest order first, down to single characters."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, hash_sample, id_fold, q, text_pass
from barloom.operators.selection import top_per_group
from barloom.session import stored

#: About so many labelled documents, chosen by the hash of their id, are learnt from.
TRAIN_DOCS = 20_000
#: Most known words, and most n-grams of each order, that the model keeps of a language, the most frequent ones first.
WORDS, GRAMS = 20_000, 10_000
#: Orders of the character n-grams that unseen words fall back to, in this order.
ORDERS = (5, 4, 3, 2, 1)
#: Added to every count; weight of a level below the words, once per level.
SMOOTHING, BACKOFF = 0.5, 0.4
#: Words in a text at which its score is no longer sharpened by length.
SHARP_WORDS = 30
#: Words whose scores a task remembers.
REMEMBERED = 200_000

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(word: str) -> list[str]:
    """Runs of letters of a word, in lower case; number signs such as fractions and Roman numerals are none."""
    found = _LETTERS.findall(word.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of a word between boundary marks; single characters without the marks."""
    padded = word if order == 1 else f"^{word}$"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


@dataclass
class Backoff:
    """Log frequencies per language: row numbers of words and of the n-grams of each order, and the rows of each level."""

    langs: list[str]
    rows: list[dict[str, int]]
    tables: list[np.ndarray]

    @property
    def levels(self) -> list[dict[str, np.ndarray]]:
        """Log frequencies by item, level by level."""
        return [{item: table[row] for item, row in rows.items()} for rows, table in zip(self.rows, self.tables)]

    @classmethod
    def from_counts(cls, rows: list[tuple[str, int, str, int]]) -> Backoff:
        """``rows``: (language, level, item, count); level 0 is words, level i the i-th order."""
        langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(langs)}
        levels: list[dict[str, int]] = [{} for _ in range(1 + len(ORDERS))]
        places: list[list[tuple[int, int, int]]] = [[] for _ in levels]
        for lang, level, item, n in rows:
            places[level].append((levels[level].setdefault(item, len(levels[level])), at[lang], n))
        tables = []
        for level, found in zip(levels, places):
            table = np.full((len(level), len(langs)), SMOOTHING)
            if found:
                row, col, n = np.array(found).T
                np.add.at(table, (row, col), n)
            tables.append(np.log(table / table.sum(axis=0)))
        return cls(langs, levels, tables)

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]

    def words(self, words: list[str]) -> np.ndarray:
        """Score of each word per language, relative to the mean over languages.

        A word outside the known ones takes the mean of its known n-grams of the longest order that has any.
        """
        out = np.zeros((len(words), len(self.langs)))
        # per level: words, and the rows of their items
        asked: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in self.rows]
        for i, word in enumerate(words):
            found = self.rows[0].get(word)
            found, level = ([found], 0) if found is not None else ([], 0)
            while not found and level < len(ORDERS):
                level += 1
                known = self.rows[level]
                found = [r for g in grams_of(word, ORDERS[level - 1]) if (r := known.get(g)) is not None]
            if found:
                at, first, items = asked[level]
                at.append(i)
                first.append(len(items))
                items += found
        for level, (at, first, items) in enumerate(asked):
            if at:
                sizes = np.diff(np.append(first, len(items)))
                mean = np.add.reduceat(self.tables[level][items], first) / sizes[:, None]
                out[at] = BACKOFF**level * (mean - mean.mean(axis=1, keepdims=True))
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_DOCS, fold: int = 2) -> Backoff | None:
    """Fit on about ``bound`` documents with a language whose id fold (of 4) is not ``fold``; None if there is none.

    Words are counted per language in the tasks and added up by Spark; the n-gram counts follow from the word counts.
    """
    known = docs.where(q(lang).isNotNull() & q(id_col).isNotNull() & (id_fold(id_col, 4) != fold))
    train = hash_sample(known, q(id_col), bound, known.count())

    def make():
        def work(batch):
            seen: dict[str, Counter] = {}
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                seen.setdefault(name, Counter()).update((body or "").split())
            total: Counter = Counter()
            for name, words in seen.items():
                for raw, n in words.items():
                    for w in letters_of(raw):
                        total[name, 0, w] += n
                        for level, order in enumerate(ORDERS, 1):
                            for g in grams_of(w, order):
                                total[name, level, g] += n
            if total:
                lang_, level_, item_ = zip(*total)
                yield pa.RecordBatch.from_arrays([pa.array(lang_), pa.array(level_, pa.int32()), pa.array(item_), pa.array(list(total.values()), pa.int64())], names=["l", "k", "w", "n"])

        return work

    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    counts = stored(explode_pass(train, [q(lang), q(text)], make, schema).groupBy("k", "w", "l").agg(F.sum("n").alias("n")))
    # a quota per language, so that a small one keeps its words
    order = [F.desc("n"), F.asc("w")]
    kept = top_per_group(counts.where("k = 0"), ["k", "l"], order, WORDS).unionByName(top_per_group(counts.where("k > 0"), ["k", "l"], order, GRAMS))
    rows = [(r["l"], r["k"], r["w"], r["n"]) for r in kept.orderBy("k", "l", *order).collect()]  # bounded by the quotas
    return Backoff.from_counts(rows) if rows else None


class Scorer:
    """Scores texts with a bounded memory of words: a row of ``table`` per raw word, row 0 for those without a letter."""

    def __init__(self, model: Backoff):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table, self.used = np.zeros((4096, len(self.model.langs))), 1

    def _learn(self, raw: list[str]) -> None:
        """Rows of new raw words."""
        runs = [letters_of(w) for w in raw]
        sizes = np.array([len(r) for r in runs])
        some = np.flatnonzero(sizes)
        for w in raw:
            self.at[w] = 0
        if not len(some):
            return
        scores = self.model.words([x for r in runs for x in r])
        rows = np.add.reduceat(scores, (np.cumsum(sizes) - sizes)[some])
        end = self.used + len(some)
        if end > len(self.table):
            self.table = np.concatenate((self.table[: self.used], np.zeros((max(end, 2 * len(self.table)) - self.used, self.table.shape[1]))))
        self.table[self.used : end] = rows
        for k, i in enumerate(some.tolist(), self.used):
            self.at[raw[i]] = k
        self.used = end

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > REMEMBERED:
            self._clear()
        at = self.at
        counted = [Counter((t or "").split()) for t in texts]
        new = {w for seen in counted for w in seen if w not in at}
        if new:
            self._learn(sorted(new))
        langs, scores = [], []
        for seen in counted:
            rows = np.fromiter(map(at.__getitem__, seen), np.int64, len(seen))
            weight = np.fromiter(seen.values(), np.float64, len(seen))
            letters = weight[rows > 0].sum()
            if not letters:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = (weight @ self.table[rows]) / max(1.0, letters / SHARP_WORDS)
            z = np.exp(z - z.max())
            langs.append(self.model.langs[int(z.argmax())])
            scores.append(float(z.max() / z.sum()))
        return langs, scores


def identify(docs: DataFrame, model: Backoff | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row.

    Null and repeated ids pass through.  A null text or one without a letter is ``und`` with score 0, and so is every text without a model.  Ties go to the
    language that sorts first.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    source = docs.select(q(id_col).alias("doc_id"), q(text).alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def make():
        scorer = Scorer(model)

        def work(texts):
            langs, scores = scorer(texts)
            return [pa.array(langs), pa.array(scores, pa.float64())]

        return work

    return text_pass(source, make, fields)
