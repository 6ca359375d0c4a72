"""Quality rules with DataFrame functions only: base counts, and divergence of a document's character classes and common
words from language references by the Jensen-Shannon distance (base 2, so between 0 and 1).

References are the mean class shares and the common-word shares over all documents of a language.  A document passes if
some language is near enough in both histograms; a histogram over too little text is not compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import q
from barloom.session import stored

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"],
    "de": ["als", "am", "an", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "werden", "zu"],
    "fr": ["au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "qui", "que", "sur", "un", "une"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
}
#: Character classes, in the order in which they are taken out of the text; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "space": r"[ \t-\r]+", "upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"""[.,;:!?'"()\-]+""", "symbol": r"[#*$%&|<>]+"}
SPACE = r"[ \t-\r]+"
#: Largest distances, and the words and characters below which a histogram is not compared.
CLASS_LIMIT, WORD_LIMIT = 0.35, 0.8
MIN_CHARS, MIN_WORDS = 200, 50
#: Base rules: least words, window of the repeat count, most words in repeated windows (percent).
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Languages whose references are held as constants, the most frequent ones; those of all others stay in a table.
LANGUAGES = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the array."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(placed, count))

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), covered)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def common_counts(words: Column) -> Column:
    """array<struct<w, n>>: how often each common word occurs, in order of the words."""
    known = sorted({f for ws in COMMON_WORDS.values() for w in ws for f in (w, w.capitalize(), w.upper())})
    found = F.sort_array(F.transform(F.filter(words, lambda w: w.isin(known)), lambda w: F.lower(w)))

    def runs(c: Column) -> Column:
        starts = F.filter(F.transform(c, lambda w, j: F.when(F.get(c, j - 1) == w, F.lit(-1)).otherwise(j)), lambda j: j >= 0)
        return let(starts, lambda s: F.transform(s, lambda p, k: F.struct(F.get(c, p).alias("w"), (F.coalesce(F.get(s, k + 1), F.size(c)) - p).alias("n"))))

    return let(found, runs)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and histograms per row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    classes (array of counts in the order of ``CLASSES`` without space, then the rest), common."""
    out = docs.select(q(id_col).alias("doc_id"), q(lang).cast("string").alias("lang"), F.coalesce(q(text).cast("string"), F.lit("")).alias("t"))
    left, lengths = "t", []
    for i, (name, pattern) in enumerate(CLASSES.items()):
        out = out.withColumn(f"t{i}", F.regexp_replace(left, pattern, ""))
        lengths.append((name, F.length(left) - F.length(f"t{i}")))
        left = f"t{i}"
    by_class = dict(lengths)
    classes = F.array(*[by_class[c] for c in CLASSES if c != "space"], F.length(left))
    out = out.withColumn("words", words_of(F.col("t")))
    return out.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - by_class["space"]).cast("long").alias("word_chars"),
        by_class["symbol"].cast("long").alias("n_symbols"),
        duplicate_lines(F.col("t")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        classes.alias("classes"),
        common_counts(F.col("words")).alias("common"),
    )


@dataclass(frozen=True)
class Reference:
    """Class shares and common-word shares of a language."""

    lang: str
    classes: list[float]
    words: dict[str, float]


def _class_shares() -> list[Column]:
    total = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    return [F.avg(F.when(total > 0, F.get("classes", F.lit(i)) / total)).alias(f"s{i}") for i in range(len(CLASSES))]


def references(counts: DataFrame) -> list[Reference]:
    """One reference per language over all rows of ``counts``, for the ``LANGUAGES`` most frequent ones; see ``other_references``."""
    k, shares = len(CLASSES), _class_shares()
    top = counts.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), *shares).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    names = [r["lang"] for r in top]
    seen: dict[str, dict[str, int]] = {name: {} for name in names}
    pairs = counts.where(F.col("lang").isin(names)).select("lang", F.explode("common").alias("e")).groupBy("lang", "e.w").agg(F.sum("e.n").alias("n"))
    for r in pairs.collect():  # languages times common words
        seen[r["lang"]][r["w"]] = r["n"]
    out = []
    for r in top:
        words = seen[r["lang"]]
        size = sum(words.values())
        out.append(Reference(r["lang"], [r[f"s{i}"] or 0.0 for i in range(k)], {w: n / size for w, n in sorted(words.items())}))
    return out


def other_references(counts: DataFrame, held: list[Reference]) -> DataFrame:
    """(lang, shares, words) of every language without a held reference: class shares and map of common-word shares."""
    rest = counts.where(F.col("lang").isNotNull() & ~F.col("lang").isin([r.lang for r in held]))
    shares = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(CLASSES))])
    classes = rest.groupBy("lang").agg(*_class_shares()).select("lang", shares.alias("shares"))
    pairs = rest.select("lang", F.explode("common").alias("e")).groupBy("lang", "e.w").agg(F.sum("e.n").alias("n"))
    words = pairs.groupBy("lang").agg(F.collect_list(F.struct("w", "n")).alias("seen"), F.sum("n").alias("size"))  # at most all common words
    words = words.select("lang", F.map_from_entries(F.transform("seen", lambda e: F.struct(e["w"], e["n"] / F.col("size")))).alias("words"))
    return classes.join(words, "lang", "left")


def _term(p: Column, other: Column) -> Column:
    """p log2(2p / (p + other)), zero for p = 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + other))).otherwise(F.lit(0.0))


def class_distance(classes: Column, reference: list[Column]) -> Column:
    """Distance to the class shares of a reference."""
    total = F.aggregate(classes, F.lit(0), lambda a, x: a + x)
    js = F.lit(0.0)
    for i, r in enumerate(reference):
        p = F.get(classes, F.lit(i)) / F.greatest(total, F.lit(1))
        js = js + 0.5 * (_term(p, r) + _term(r, p))
    return F.sqrt(F.greatest(js, F.lit(0.0)))


def constant_words(reference: Reference) -> Column:
    return F.create_map(*[F.lit(x) for pair in reference.words.items() for x in pair]) if reference.words else F.create_map(F.lit(""), F.lit(0.0))


def word_distance(common: Column, shares: Column, some: Column) -> Column:
    """Distance to the word shares of a reference (``some``: it has any).  Only the document's own words are visited: a word that it lacks adds half its reference share.

    A document without any common word is as far as can be (1) from a reference that has some.
    """
    total = F.greatest(F.aggregate(common, F.lit(0), lambda a, e: a + e["n"]), F.lit(1))

    def step(a: Column, e: Column) -> Column:
        def add(r: Column) -> Column:
            p = e["n"] / total
            return F.struct((a["js"] + 0.5 * (_term(p, r) + _term(r, p))).alias("js"), (a["seen"] + r).alias("seen"))

        return let(F.coalesce(F.try_element_at(shares, e["w"]), F.lit(0.0)), add)

    start = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("seen"))
    apart = F.aggregate(common, start, step, lambda a: F.sqrt(F.greatest(F.lit(0.0), a["js"] + 0.5 * F.greatest(F.lit(0.0), 1 - a["seen"]))))
    return F.when(F.size(common) == 0, F.when(some, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(apart)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance), one row per input row; the distances are those to the nearest language.

    A null text has no word and fails the base rules.  Rows with a null language are judged but make no reference;
    without any reference only the base rules count.
    """
    counts = stored(document_counts(docs, id_col, text, lang))
    known = references(counts)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = [
        F.struct(class_distance(F.col("classes"), [F.lit(s) for s in r.classes]).alias("c"), word_distance(F.col("common"), constant_words(r), F.lit(bool(r.words))).alias("w"))
        for r in known
    ]
    least = lambda part: F.array_min(F.transform("far", lambda d: d[part]))
    rows = counts.select("*", failed.alias("base_failed"), F.array(*far).alias("far") if far else F.lit(None).cast("array<struct<c:double,w:double>>").alias("far"))
    rows = rows.select("*", F.exists("far", _near).alias("near"), least("c").alias("class_distance"), least("w").alias("word_distance")).drop("far")
    if len(known) == LANGUAGES:
        rows = _with_others(rows, other_references(counts, known))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("near"), F.lit(True))).alias("kept"), "class_distance", "word_distance",
    )


def _near(d: Column) -> Column:
    long_enough = F.col("word_chars") >= MIN_CHARS
    many_words = F.col("n_words") >= MIN_WORDS
    return (~long_enough | (d["c"] <= CLASS_LIMIT)) & (~many_words | (d["w"] <= WORD_LIMIT))


def _with_others(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Verdict and least distances over the references of a table as well; each row meets each of them.

    That pairing is by nature rows times languages; it holds one pair at a time and is empty for up to ``LANGUAGES``.
    """
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    pairs = rows.select("__row", "classes", "common", "word_chars", "n_words").crossJoin(stored(others))
    c = class_distance(F.col("classes"), [F.get("shares", F.lit(i)) for i in range(len(CLASSES))])
    some = F.col("words").isNotNull()
    w = word_distance(F.col("common"), F.coalesce("words", F.create_map(F.lit(""), F.lit(0.0))), some)
    judged = pairs.select("__row", "word_chars", "n_words", F.struct(c.alias("c"), w.alias("w")).alias("d"))
    best = judged.groupBy("__row").agg(F.max(_near(F.col("d"))).alias("__near"), F.min("d.c").alias("__c"), F.min("d.w").alias("__w"))
    out = rows.join(best, "__row", "left")
    near = F.col("near") | F.coalesce("__near", F.lit(False))
    return out.withColumns({"near": near, "class_distance": F.least("class_distance", "__c"), "word_distance": F.least("word_distance", "__w")})
