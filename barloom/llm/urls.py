"""URL filter: host and path rules first, then naive Bayes over words that hosts and paths are made of.

Concatenated names are split into words by a unigram Viterbi search; the word frequencies come from the text of all
pages.  The multinomial naive Bayes model learns from the pages that a rule decides, plus a few stated words as prior
counts, and judges the others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import explode_pass, q, text_pass, top_rows

# Words that stand for either class before any page is seen, each worth PRIOR_COUNT occurrences.
BLOCK_WORDS = ["adult", "bet", "betting", "bonus", "casino", "cheap", "crypto", "escort", "gamble", "jackpot", "loan", "lottery", "nude", "payday", "pharma", "pills", "poker", "porn", "sex", "slots", "viagra", "win", "xxx"]
ALLOW_WORDS = ["archive", "blog", "college", "docs", "edu", "encyclopedia", "forum", "health", "history", "journal", "learn", "library", "museum", "news", "research", "school", "science", "university", "wiki", "www"]
PRIOR_COUNT = 5

#: Most words of the segmentation model and most tokens of the classifier (the most frequent ones), both kept on the driver.
WORDS, TOKENS = 50_000, 50_000
#: Longest word of a segmentation, and hosts whose split a task remembers.
LONGEST, REMEMBERED = 24, 100_000
SMOOTHING = 1.0


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains, for urls whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and path up to a query or fragment; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.  ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame, html: str = "html") -> dict[str, int]:
    """The most frequent words (2 to ``LONGEST`` letters a-z) in the text of all pages, at most ``WORDS`` of them."""
    text = F.regexp_replace(F.lower(F.coalesce(q(html), F.lit(""))), r"<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where(F.col("w").rlike(f"^[a-z]{{2,{LONGEST}}}$"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    return {r["w"]: r["n"] for r in top_rows(top, [F.desc("n"), F.col("w")], WORDS).collect()}


class Segmenter:
    """Most probable split of a run of letters into words; an unknown word costs more with each letter."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.logs = {w: log(n / total) for w, n in counts.items()}
        self.unknown = log(0.1 / total)

    def split(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for at in range(max(0, end - LONGEST), end):
                w = name[at:end]
                options.append((best[at][0] + self.logs.get(w, self.unknown - len(w) * log(10.0)), -at))
            score, at = max(options)
            best.append((score, -at))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def tokens(self, part: str) -> list[str]:
        """Words of a host or path: runs of letters are split, a run of digits is one token of its length."""
        out = []
        for run in re.findall(r"[a-z]+|[0-9]+|[^\W\d_]+", part.lower()):
            out += [f"<{min(len(run), 9)} digits>"] if run[0].isdigit() else self.split(run) if run.isascii() else [run]
        return out


@dataclass
class NaiveBayes:
    """Log odds of block against allow: a start value and one per token; unseen tokens say nothing."""

    start: float
    odds: dict[str, float]

    @classmethod
    def from_counts(cls, pages: dict[str, int], tokens: dict[tuple[str, str], int]) -> NaiveBayes:
        vocabulary = {w for _, w in tokens}
        total = {v: sum(n for (k, _), n in tokens.items() if k == v) + SMOOTHING * max(1, len(vocabulary)) for v in ("block", "allow")}
        one = lambda v, w: (tokens.get((v, w), 0) + SMOOTHING) / total[v]
        start = log((pages.get("block", 0) + 1) / (pages.get("allow", 0) + 1))
        return cls(start, {w: log(one("block", w) / one("allow", w)) for w in vocabulary})

    def score(self, tokens: list[str]) -> float:
        s = self.start + sum(self.odds.get(w, 0.0) for w in tokens)
        return 1 / (1 + exp(-max(-500.0, min(500.0, s))))


def _tokens(segmenter: Segmenter):
    known: dict[str, list[str]] = {}

    def of(host: str, path: str) -> list[str]:
        words = known.get(host)
        if words is None:
            if len(known) >= REMEMBERED:
                known.clear()
            words = known[host] = ["h:" + w for w in segmenter.tokens(host)]
        return words + ["p:" + w for w in segmenter.tokens(path)]

    return of


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score), one row per input row.

    ``score`` is the classifier's probability of block, ``verdict`` that of the rule or block from 0.5 on.  A null or
    malformed url has empty host and path and no words; its score is the share of blocked pages.  Without any page that
    a rule decides, the stated words alone decide.
    """
    host, path = host_and_path(q(url))
    parsed = pages.select(q(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("r")).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule"))
    segmenter = Segmenter(word_counts(pages, html) | {w: 10_000 for w in BLOCK_WORDS + ALLOW_WORDS})

    decided = parsed.where("by_rule is not null")
    counts = {r[0]: r[1] for r in decided.groupBy("by_rule").agg(F.count("*")).collect()}

    def make():
        of = _tokens(segmenter)

        def work(batch):
            seen: dict[tuple[str, str], int] = {}
            for v, h, p in zip(*(c.to_pylist() for c in batch.columns)):
                for w in of(h, p):
                    seen[v, w] = seen.get((v, w), 0) + 1
            if seen:
                v, w = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(list(seen.values()), pa.int64())], names=["v", "w", "n"])

        return work

    schema = T.StructType([T.StructField("v", T.StringType()), T.StructField("w", T.StringType()), T.StructField("n", T.LongType())])
    found = explode_pass(decided, [F.col("by_rule"), F.col("host"), F.col("path")], make, schema)
    top = found.groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v") == "block", F.col("n")).otherwise(0)).alias("b"))
    tokens: dict[tuple[str, str], int] = {}
    for r in top_rows(top, [F.desc("n"), F.col("w")], TOKENS).collect():
        tokens["block", r["w"]], tokens["allow", r["w"]] = r["b"], r["n"] - r["b"]
    for verdict, words in (("block", BLOCK_WORDS), ("allow", ALLOW_WORDS)):
        for w in words:
            for place in ("h:", "p:"):
                tokens[verdict, place + w] = tokens.get((verdict, place + w), 0) + PRIOR_COUNT
    model = NaiveBayes.from_counts(counts, tokens)

    def score():
        of = _tokens(segmenter)

        def work(pairs):
            words = [of(*p.split("\x00", 1)) for p in pairs]
            return [pa.array([" ".join(w) for w in words]), pa.array(np.array([model.score(w) for w in words], np.float64))]

        return work

    scored = text_pass(parsed.withColumn("both", F.concat("host", F.lit("\x00"), "path")), score, [T.StructField("words", T.StringType()), T.StructField("score", T.DoubleType())], text="both")
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "words", "score")
