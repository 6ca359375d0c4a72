"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Besides the stated lexicons, words and word beginnings that are much more frequent in toxic documents are learnt from a
part of the training documents; the trees see them only as densities on the other part, and the calibration on a third.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, hash_sample, id_fold, labelled, q, text_pass, top_rows
from barloom.session import stored

# Insults, harsh adjectives, threats and second-person words of English, German, French and Spanish.
INSULTS = [
    "asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "dumbass", "fool", "freak", "garbage", "idiot", "imbecile", "jerk", "liar",
    "loser", "lunatic", "maggot", "moron", "parasite", "pig", "rat", "scum", "slut", "trash", "vermin", "whore",
    "abschaum", "arschloch", "dummkopf", "hurensohn", "idioten", "schlampe", "schwein", "trottel", "versager",
    "connard", "connasse", "crétin", "ordure", "salaud", "salope", "abruti", "imbécile",
    "cabrón", "escoria", "estúpido", "gilipollas", "idiota", "imbécil", "maldito", "puta", "basura",
]
HARSH = [
    "awful", "despicable", "dirty", "disgusting", "dumb", "filthy", "hideous", "ignorant", "insane", "lame", "lousy", "miserable", "nasty", "pathetic",
    "retarded", "ridiculous", "shameful", "sick", "stupid", "ugly", "useless", "vile", "wicked", "worthless",
    "dumm", "ekelhaft", "erbärmlich", "hässlich", "wertlos", "dégoûtant", "minable", "stupide", "asqueroso", "inútil", "patético",
]
THREATS = ["beat", "die", "hang", "hate", "hurt", "kill", "murder", "punch", "shoot", "stab", "hasse", "töten", "déteste", "tuer", "matar", "odio"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dein", "euch", "tu", "toi", "ton", "vous", "votre", "tú", "usted", "ustedes", "vosotros"]
# Look-alikes that hide letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""}

FEATURES = (
    "log_words", "insult_density", "harsh_density", "threat_density", "hit_count", "distinct_hits", "near_you", "you_density",
    "upper_share", "upper_words", "mark_share", "shout_share", "hidden_share", "hidden_hits", "stretched_share",
    "learnt_density", "learnt_weight", "learnt_hits", "learnt_top",
)
#: Words between a lexicon hit and a second-person word that count as near.
NEAR = 5
#: About so many labelled documents, chosen by the hash of their id, are learnt from; part of them calibrate.
TRAIN_DOCS = 20_000
TREES, DEPTH, SEED = 20, 3, 5
THRESHOLD = 0.5
#: Learnt lexicon: lengths of word beginnings, least log odds, least toxic documents of an entry (number and share), most entries.
BEGINNINGS, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE, ENTRIES = (5, 6, 7, 8), 2.0, 3, 0.004, 20_000
#: Words whose kind a task remembers.
REMEMBERED = 200_000

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_UNMASK = str.maketrans(LOOK_ALIKES)
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
INSULT, HARSH_WORD, THREAT, YOU, HIDDEN, STRETCHED, UPPER = (1 << i for i in range(7))


def bare(raw: str) -> str:
    """A raw word in lower case without marks at its ends."""
    return raw.strip(_EDGES).lower()


def entries_of(word: str) -> list[str]:
    """Lexicon entries of a bare word: itself, and its beginnings with a dash."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)]


class Kinds:
    """What a raw word is: lexicon hit, second person, hidden by look-alikes or marks inside, stretched, in capitals.

    The bits of the kind, and from bit 8 on the log odds of the word's strongest learnt entry in sixteenths.
    """

    def __init__(self, learnt: dict[str, float] | None = None):
        self.learnt = learnt or {}
        self.lexicon: dict[str, int] = {}
        for words, kind in ((INSULTS, INSULT), (HARSH, HARSH_WORD), (THREATS, THREAT), (SECOND_PERSON, YOU)):
            for w in words:
                for form in (w, w + "s") if kind == INSULT else (w,):
                    self.lexicon[form] = self.lexicon.get(form, 0) | kind
        self.known: dict[str, int] = {}

    def __getitem__(self, raw: str) -> int:
        kind = self.known.get(raw)
        if kind is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            kind = self.known[raw] = self._of(raw)
        return kind

    def _of(self, raw: str) -> int:
        word = bare(raw)
        kind = self.lexicon.get(word, 0)
        if raw.isupper() and len(word) > 1:
            kind |= UPPER
        if _STRETCHED.search(word):
            once = re.sub(r"(.)\1\1+", r"\1", word)
            kind |= STRETCHED | self.lexicon.get(once, 0) | self.lexicon.get(re.sub(r"(.)\1\1+", r"\1\1", word), 0)
        if not kind & (INSULT | HARSH_WORD | THREAT) and word and not word.isalpha() and any(c.isalpha() for c in word):
            plain = re.sub(r"[\W_]", "", word.translate(_UNMASK))
            if plain.isalpha():
                kind |= HIDDEN | (self.lexicon.get(plain, 0) & ~YOU)
        if self.learnt:
            odds = max((self.learnt.get(e, 0.0) for e in entries_of(word)), default=0.0)
            kind |= int(16 * min(odds, 15.0)) << 8
        return kind


def features(text: str | None, kinds: Kinds) -> list[float]:
    """Dense features of a text in the order of ``FEATURES``; all zero without a word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    k = np.fromiter((kinds[w] for w in words), np.int64, n)
    odds = (k >> 8) / 16.0
    learnt = np.flatnonzero(odds)
    hits = np.flatnonzero(k & (INSULT | HARSH_WORD | THREAT))
    you = np.flatnonzero(k & YOU)
    near = 0
    if len(hits) and len(you):
        after = np.searchsorted(you, hits)
        right = np.where(after < len(you), you[np.minimum(after, len(you) - 1)] - hits, n)
        left = np.where(after > 0, hits - you[np.maximum(after - 1, 0)], n)
        near = int((np.minimum(left, right) <= NEAR).sum())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = max(1, int(counts[33:].sum() - counts[0x80:0xC0].sum()))
    upper = int(counts[65:91].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    rate = lambda bits: float(((k & bits) > 0).sum()) / (n + 20) * 100
    return [
        float(np.log1p(n)), rate(INSULT), rate(HARSH_WORD), rate(THREAT), float(np.log1p(len(hits))),
        float(len({bare(words[i]) for i in hits})), float(np.log1p(near)), rate(YOU),
        upper / chars, rate(UPPER), marks / chars, float(counts[33]) / (n + 20), rate(HIDDEN),
        float(((k & HIDDEN) > 0)[hits].sum()), rate(STRETCHED),
        len(learnt) / (n + 20) * 100, float(odds.sum()) / (n + 20) * 100, float(np.log1p(len({bare(words[i]) for i in learnt}))), float(odds.max()),
    ]


def with_features(docs: DataFrame, learnt: dict[str, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def make():
        kinds = Kinds(learnt)
        return lambda texts: [pa.array([features(t, kinds) for t in texts], pa.list_(pa.float64()))]

    return text_pass(docs, make, [T.StructField("__x", T.ArrayType(T.DoubleType()))], text=text, keep=keep)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Log odds (toxic against not) of words and word beginnings by the documents of ``train`` (__t, __y) that hold them.

    Equal texts count once.  At most ``ENTRIES`` entries, the strongest, come to the driver.
    """
    once = train.where("__t is not null").groupBy(F.xxhash64("__t").alias("__h")).agg(F.first("__t").alias("__t"), F.max("__y").alias("__y"))

    def make():
        def work(batch):
            seen = (Counter(), Counter())
            for body, y in zip(*(c.to_pylist() for c in batch.columns)):
                seen[y].update({e for w in {bare(raw) for raw in body.split()} if w.isalpha() for e in entries_of(w)})
            both = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(both, pa.string()), *(pa.array([c[e] for e in both], pa.int64()) for c in seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["e", "n", "p"])

        return work

    schema = T.StructType([T.StructField("e", T.StringType()), T.StructField("n", T.LongType()), T.StructField("p", T.LongType())])
    n, p = 0, 0
    for r in once.groupBy("__y").agg(F.count("*").alias("c")).collect():
        n, p = (n, r["c"]) if r["__y"] else (r["c"], p)
    if not n or not p:
        return {}
    counts = explode_pass(once, [F.col("__t"), F.col("__y")], make, schema).groupBy("e").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    top = counts.where(F.col("p") >= max(LEAST_DOCS, LEAST_SHARE * p)).withColumn("o", odds).where(F.col("o") >= LEAST_ODDS)
    return {r["e"]: r["o"] for r in top_rows(top, [F.desc("o"), F.col("e")], ENTRIES).collect()}


@dataclass
class Calibrated:
    """Learnt lexicon, boosted trees and the isotonic map of their raw score."""

    learnt: dict[str, float]
    trees: GBTClassificationModel
    curve: IsotonicRegressionModel

    def transform(self, rows: DataFrame) -> DataFrame:
        raw = self.trees.transform(rows.withColumn("__v", array_to_vector("__x"))).withColumn("__raw", vector_to_array("__p")[1])
        return self.curve.transform(raw).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__s"))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", bound: int = TRAIN_DOCS, holdout: int = 0) -> Calibrated | None:
    """Fit on about ``bound`` labelled rows outside the hold-out fold of 5: folds 1 and 2 give the lexicon, 3 the trees,
    4 the calibration.  If the last two do not hold both classes each, all of them serve for both; None if these do not.
    """
    known = labelled(labels, "toxic", id_col).where(id_fold("__id", 5) != holdout)
    total = known.count()
    chosen = hash_sample(known, F.col("__id"), bound, total)
    source = hash_sample(docs.where(q(id_col).isNotNull()), q(id_col), bound, total)  # the same hash on the other side
    train = source.join(chosen, q(id_col) == F.col("__id")).select(q(text).cast("string").alias("__t"), "__y", id_fold("__id", 5).alias("__fold"))
    train = stored(train.repartition(8))
    learnt = learn_lexicon(train.where("__fold in (1, 2)"))
    rows = with_features(train, learnt, "__t", ["__y", "__fold"]).withColumn("__v", array_to_vector("__x"))
    rows = stored(rows.withColumn("__y", F.col("__y").cast("double")))
    held = {(r["__fold"], r["__y"]) for r in rows.groupBy("__fold", "__y").agg(F.count("*")).collect()}
    if len({y for _, y in held}) < 2:
        return None
    whole = {(3, 0.0), (3, 1.0), (4, 0.0), (4, 1.0)} <= held
    boosting = GBTClassifier(
        featuresCol="__v", labelCol="__y", predictionCol="__g", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, minInstancesPerNode=5, seed=SEED
    )
    trees = boosting.setRawPredictionCol("__r").setProbabilityCol("__p").fit(rows.where("__fold = 3") if whole else rows)
    raw = trees.transform(rows.where("__fold = 4") if whole else rows).withColumn("__raw", vector_to_array("__p")[1])
    curve = IsotonicRegression(featuresCol="__raw", labelCol="__y", predictionCol="__s").fit(raw)
    return Calibrated(learnt, trees, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``.

    A null or empty text has all features zero and gets the score of that point; null ids are scored, never learnt
    from; repeated rows get equal scores.  Without labelled rows of both classes every score is 0.
    """
    model = fit(docs, labels, id_col, text)
    if model is None:
        return docs.select(q(id_col), F.lit(0.0).alias("score"))
    return model.transform(with_features(docs, model.learnt, text, keep=[id_col])).select(q(id_col), "score")
