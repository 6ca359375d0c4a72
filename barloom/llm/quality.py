"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk toward its own diagonal and toward a multiple of the identity.  The
Cholesky factors are computed once per fit; a score is the logistic of the difference of two Gaussian log densities
(Mahalanobis terms by triangular products with the inverse factors, log determinants) plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, id_fold, labelled, q, text_pass
from barloom.session import stored

FEATURES = (
    "log_words", "log_word_length", "upper", "digit", "symbol", "pipe", "shout", "stop_mark", "comma", "non_ascii",
    "distinct_words", "repeated_triples", "top_word", "repeated_lines", "log_line_length",
)
#: Shrinkage toward the diagonal and toward the mean variance, and the least variance of a feature.
TO_DIAGONAL, TO_IDENTITY, LEAST_VARIANCE = 0.1, 0.02, 1e-4
#: Added to what a share is taken of, so that a few words do not make an extreme one.
SMOOTH = 8
#: A document with a score of at least this is predicted as good.
THRESHOLD = 0.3

_SYMBOLS = np.frombuffer(b"#*$%&<>@^~\\_=+{}[]", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text, in the order of ``FEATURES``; all zero for a text without a word.

    Shares are taken as arc sines of square roots, which evens out their variance, and sizes as logarithms.
    """
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, int(counts.sum() - counts[0x80:0xC0].sum() - counts[[9, 10, 11, 12, 13, 32]].sum()))
    upper = int(counts[65:91].sum())
    letters = max(1, upper + int(counts[97:123].sum()) + int(counts[0xC0:].sum()))
    seen = Counter(words)
    triples = max(1, n - 2)
    repeated = 1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 3 else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda x, of: float(np.arcsin(np.sqrt(min(1.0, max(0.0, x / (of + SMOOTH))))))
    return [
        float(np.log1p(n)),
        float(np.log(chars / n)),
        share(upper, letters),
        share(int(counts[48:58].sum()), chars),
        share(int(counts[_SYMBOLS].sum()), chars),
        share(int(counts[124]), n),
        share(int(counts[33]), n),
        share(int(counts[46] + counts[63]), n),
        share(int(counts[44]), n),
        share(int(counts[0xC0:].sum()), letters),
        float(np.log(len(seen)) / np.log(n)) if n > 1 else 1.0,
        share(repeated * triples, triples),
        share(max(seen.values()) - 1, n),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(raw) / len(lines))),
    ]


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "__x") -> DataFrame:
    """``keep`` columns and the feature array ``name``."""

    def make():
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return text_pass(docs, make, [T.StructField(name, T.ArrayType(T.DoubleType()))], text=text, keep=keep)


@dataclass
class QuadraticDiscriminant:
    """Two Gaussian classes: means, inverse Cholesky factors, log determinants and log prior odds of class 1."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    @classmethod
    def from_sums(cls, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> QuadraticDiscriminant | None:
        """From counts, sums and sums of outer products per class; None if a class has no row."""
        if min(n) < 1:
            return None
        d = sums.shape[1]
        means = sums / n[:, None]
        factors, dets = [], []
        for k in (0, 1):
            cov = squares[k] / n[k] - np.outer(means[k], means[k])
            diagonal = np.maximum(np.diag(cov), LEAST_VARIANCE)
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(diagonal)
            cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * diagonal.mean() * np.eye(d) + LEAST_VARIANCE * np.eye(d)
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        return cls(means, np.array(factors), np.array(dets), float(np.log(n[1] / n[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse_factors[k].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_dets[k]))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", holdout: int | None = 0) -> QuadraticDiscriminant | None:
    """Fit on all labelled rows whose id fold (of 5) is not ``holdout``; ``features`` has the array ``__x``.

    Sums and outer products are added up per batch in the tasks and per element in an aggregation, so the driver sees
    two counts, two vectors and two matrices whatever the number of rows.
    """
    d = len(FEATURES)
    rows = features.join(labelled(labels, label, id_col), q(id_col) == F.col("__id"))
    if holdout is not None:
        rows = rows.where(id_fold(id_col, 5) != holdout)

    def make():
        def work(batch):
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                flat = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["k", "at", "v"]
                )

        return work

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("v", T.DoubleType())])
    total = np.zeros((2, 1 + d + d * d))
    for r in explode_pass(rows, [F.col("__y"), F.col("__x")], make, schema).groupBy("k", "at").agg(F.sum("v").alias("v")).collect():
        total[r["k"], r["at"]] = r["v"]
    return QuadraticDiscriminant.from_sums(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score_statistics(features: DataFrame, model: QuadraticDiscriminant | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``; without a model (a class has no labelled row) every score is 0.5."""
    if model is None:
        return features.select(*[q(c) for c in keep], F.lit(0.5).alias("score"))
    names = [f"__{i}" for i in range(len(keep))]
    source = features.select(*[q(c).alias(n) for c, n in zip(keep, names)], "__x")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = np.array(b.column(b.num_columns - 1).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x))], names=schema.fieldNames())

    return source.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "score")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``; learns from labelled rows outside fold 0 of 5.

    A null or empty text has all statistics zero and gets the score of that point; a null id is scored, never learnt
    from; repeated rows get equal scores; an empty table gives an empty result.
    """
    features = stored(with_statistics(docs, text, keep=[id_col]))
    return score_statistics(features, fit(features, labels, id_col), [id_col])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with the columns of ``docs``.

    One pass makes the statistics that the labels are joined to, so no text is shuffled; the scoring pass carries all
    columns through, so no row has to be found again by its id.
    """
    model = fit(with_statistics(docs, text, keep=[id_col]), labels, id_col)
    if model is None:
        return docs

    def make():
        return lambda texts: [pa.array(model.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))) >= threshold)]

    carried = docs.select("*", q(text).alias("__copy"))
    return text_pass(carried, make, [T.StructField("__good", T.BooleanType())], text="__copy").where("__good").drop("__good")
