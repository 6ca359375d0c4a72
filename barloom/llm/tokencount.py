"""Token counts by a unigram model: trie-shared dynamic programming over distinct pre-tokens.

The distinct pre-tokens of a batch are inserted into a trie.  Every trie node holds the best log probability of its
prefix and the tokens of that segmentation, computed once from the nodes above it, so words that share a prefix share
the work.  A word's count is read at its terminal node and multiplied with its occurrences per document.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.common import q, text_pass

#: Trie nodes that a task keeps between batches; the trie is emptied when it has more.
NODES = 400_000
#: Word start mark of the vocabulary.
MARK = "▁"
#: What a byte of a character outside the vocabulary costs beyond the rarest piece.
BYTE_PENALTY = 2.0


@dataclass(frozen=True)
class Unigram:
    """Log probabilities of pieces, the length of the longest one, and the score of a fallback byte."""

    scores: dict[str, float]
    longest: int
    byte: float


@lru_cache(maxsize=2)
def load_unigram(path: str) -> Unigram:
    """Unigram model over the vocabulary of a sentencepiece file: log probabilities by Zipf's law over the rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = float(np.log(np.reciprocal(np.arange(2.0, len(pieces) + 2)).sum()))
    scores = {p: -float(np.log(r + 2.0)) - total for r, p in enumerate(pieces)}
    return Unigram(scores, max(map(len, scores), default=1), min(scores.values(), default=0.0) - BYTE_PENALTY)


class Trie:
    """Nodes by number: children, and per node the best (score, tokens) of the prefix that ends there."""

    def __init__(self, model: Unigram):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]

    def __len__(self) -> int:
        return len(self.children)

    def terminal(self, word: str) -> int:
        """Node of ``word``, with every new node on the way computed from its ancestors."""
        node, path, children = 0, [0], self.children
        for depth, c in enumerate(word, 1):
            down = children[node].get(c)
            if down is None:
                down = len(children)
                children[node][c] = down
                children.append({})
                self._compute(word, depth, path)
            node = down
            path.append(node)
        return node

    def _compute(self, word: str, depth: int, path: list[int]) -> None:
        """Forward step: best over the pieces that end at ``depth``; ties go to fewer tokens."""
        known, score, tokens = self.model.scores, self.score, self.tokens
        n = len(word[depth - 1].encode("utf-8", "replace"))
        above = path[depth - 1]
        best, count = score[above] + n * self.model.byte, tokens[above] + n
        for at in range(max(0, depth - self.model.longest), depth):
            p = known.get(word[at:depth])
            if p is not None:
                s, t = score[path[at]] + p, tokens[path[at]] + 1
                if s > best or (s == best and t < count):
                    best, count = s, t
        score.append(best)
        tokens.append(count)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, log_score), one row per input row.

    Pre-tokens are runs of anything but ASCII white space, each with the word start mark in front.  ``n_tokens`` is the
    sum of the tokens of their most probable segmentations and ``log_score`` of their log probabilities.  A null or
    empty text has zeros; ids pass through, null and repeated ones too.
    """

    def make():
        trie = Trie(load_unigram(model_path))
        node_of: dict[bytes, int] = {}  # no longer than the trie

        def work(texts):
            if len(trie) > NODES:
                trie.clear()
                node_of.clear()
            words, tokens, scores = [], [], []
            for t in texts:
                seen = Counter((t or "").encode("utf-8", "replace").split())
                total, score = 0, 0.0
                for w, n in seen.items():
                    node = node_of.get(w)
                    if node is None:
                        node = node_of[w] = trie.terminal(MARK + w.decode("utf-8"))
                    total += n * trie.tokens[node]
                    score += n * trie.score[node]
                words.append(seen.total())
                tokens.append(total)
                scores.append(score)
            return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())]
    return text_pass(docs.select(q(id_col).alias("doc_id"), q(text).alias("text")), make, fields)
