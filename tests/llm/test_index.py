"""Merkle manifest, relative Lempel-Ziv removal and hard negatives against brute force."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import lempelziv, merkle, negatives
from tests.llm.conftest import rows_of, sentence, unique_words


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def slow_tree(nodes):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def slow_way(tree, at, digest, siblings):
    for level in tree[:-1]:
        first = at // 8 * 8
        run = level[first : first + 8]
        siblings += run[: at - first] + run[at - first + 1 :]
        digest = H(*run[: at - first], digest, *run[at - first + 1 :])
        at //= 8
    return digest


def slow_audit(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r, r["text"]), r))
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        by[k].sort(key=lambda x: x[:3])
        trees[k] = slow_tree([x[2] for x in by[k]])
    top = slow_tree([trees[k][-1][0] for k in order])
    out = []
    for at_key, k in enumerate(order):
        for at, (known, _, leaf, r) in enumerate(by[k]):
            text = r["text"]
            if known and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            siblings = []
            folded = slow_way(top, at_key, slow_way(trees[k], at, slow_leaf(r, text), siblings), siblings)
            out.append((r["doc_id"], leaf, trees[k][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def audited(docs):
    return sorted([tuple(r) for r in merkle.audit_documents(docs).collect()], key=str)


def test_manifest_matches_brute_force(docs_of, awkward):
    for docs in (awkward, docs_of(["Only One"])):
        assert audited(docs) == slow_audit(docs.collect())


@pytest.mark.parametrize("depth", [1, 2])
def test_blocks_of_a_tree(docs_of, monkeypatch, depth):
    """Small blocks: trees over several block levels, with single nodes in a last run, and more keys than a run."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SPAN", 8**depth)
    rng = np.random.default_rng(2)
    rows = [(i, f"Text {i}", "en" if i < 521 else str(rng.choice(list("abcdefghijklm"))), "s", 3, None, None, None, None, None) for i in range(600)]
    docs = docs_of(rows, 4)
    got = audited(docs)
    assert got == slow_audit(docs.collect())
    assert {g[-1] for g in got} == {True, False}


def test_midstates_resume():
    digests = [H(str(i)).encode() for i in range(100)]
    block = merkle.Block(digests, 3)
    tree = slow_tree([d.decode() for d in digests])
    assert block.top == [tree[-1][0].encode()]
    for at in (0, 7, 63, 96, 99):
        changed = slow_tree([("0" * 64 if i == at else d.decode()) for i, d in enumerate(digests)])
        assert block.fold(at, b"0" * 64).decode() == changed[-1][0]
        assert block.fold(at, digests[at]) == block.top[0]


def test_manifest_of_nothing(no_docs):
    out = merkle.audit_documents(no_docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_cut(rows):
    """(doc_id, text) -> words, removed, kept text."""
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 12):
            f = first.get(tuple(w[i : i + 13]))
            if f is not None and (doc is None or f < doc):
                gone.update(range(i, i + 13))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def cut(docs):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in lempelziv.remove_repeats(docs).collect()], key=str)


def shared_passages(rng, n=150):
    """Documents of random words with passages of 8 to 40 words that occur in many of them, cut at random places."""
    base = [unique_words(rng, 40) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [unique_words(rng, int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 4))):
            p = base[int(rng.integers(6))]
            a = int(rng.integers(0, 28))
            parts += [p[a : a + int(rng.integers(8, 40))], unique_words(rng, int(rng.integers(0, 6)))]
        texts.append(" ".join(w for p in parts for w in p))
    return texts


def test_removal_matches_brute_force(docs_of):
    rng = np.random.default_rng(11)
    texts = shared_passages(rng) + [sentence(rng, 300, ["a", "b"]) for _ in range(20)] + ["to and fro " * 40, "to and fro " * 30, ("w " * 13).strip(), ("w " * 12).strip(), ("w " * 14).strip()]
    rng.shuffle(texts)
    for parts in (1, 7):
        docs = docs_of(texts, parts)
        got = cut(docs)
        assert got == slow_cut(list(enumerate(texts)))
    assert sum(g[2] for g in got) > 1000


def test_removal_of_awkward_rows(awkward, no_docs):
    assert cut(awkward) == slow_cut([(r["doc_id"], r["text"]) for r in awkward.collect()])
    out = lempelziv.remove_repeats(no_docs)
    assert out.count() == 0
    assert {"a.b", "doc", "n_words", "n_removed", "kept_text"} <= set(out.columns)


def test_pieces_and_small_blocks(docs_of, monkeypatch):
    """Texts read in pieces, blocks of few rows, and every phrase or no phrase counted as frequent."""
    rng = np.random.default_rng(4)
    texts = shared_passages(rng, 60) + [sentence(rng, 500, ["x", "y", "z"]) for _ in range(12)]
    monkeypatch.setattr(lempelziv, "PIECE", 97)
    want = slow_cut(list(enumerate(texts)))
    every = lempelziv._PHRASE
    for heavy in ("none", "all"):
        keys = np.empty(0, np.int64)
        rows = lempelziv._rows(docs_of(texts, 3), "doc_id", "text")
        if heavy == "all":
            found = lempelziv.phrases(rows, keys).select("key").distinct().collect()
            keys = np.sort(np.array([r[0] for r in found], np.int64))
        sent = lempelziv.phrases(rows, keys).orderBy("key", "doc", "at").toArrow().to_batches(max_chunksize=50)
        assert [f.name for f in every.fields] == sent[0].schema.names
        monkeypatch.setattr(lempelziv, "ROWS", 80)
        at = defaultdict(list)
        for b in lempelziv._parsed(iter(sent)):
            for doc, where in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                at[doc].append(where)
        got = [(i, len(words(t)), int((gone := lempelziv.covered(len(words(t)), at[i])).sum()), " ".join(w for w, g in zip(words(t), gone) if not g)) for i, t in enumerate(texts)]
        assert sorted(got, key=str) == want


def test_parse_crosses_factor_boundaries():
    """The window across the end of a factor has another reference."""
    hashes = np.array([1, 2, 3, 3, 4, 5, 1, 2, 3, 4, 5], np.uint64)
    counts = np.array([3, 3, 5])
    block = lempelziv._Block(np.zeros(3, np.int64), np.array([1, 2, 3]), counts, hashes)
    row, first, length = block.parse(np.array([2]))
    assert sorted(zip(row.tolist(), first.tolist(), length.tolist())) == [(2, 0, 3), (2, 3, 2)]


def test_frequent_windows_are_sent_once(docs_of):
    """A passage of many documents is as many rows as tasks."""
    rng = np.random.default_rng(8)
    hot = unique_words(rng, 60)
    texts = [" ".join([*unique_words(rng, 20), *hot, *unique_words(rng, 20)]) for _ in range(400)]
    rows = lempelziv._rows(docs_of(texts, 4), "doc_id", "text")
    heavy = lempelziv.frequent(rows)
    assert len(heavy)
    sent = lempelziv.phrases(rows, heavy).where("windows is not null")
    most = sent.groupBy("key").agg(F.countDistinct("doc").alias("n")).agg(F.max("n")).first()[0]
    assert most < 40
    assert cut(docs_of(texts, 4)) == slow_cut(list(enumerate(texts)))


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("leaf", T.StringType()), T.StructField("score", T.StringType())]
)


def slow_negatives(rows):
    kept = []
    for i, v, label in dict.fromkeys((r[0], None if r[1] is None else tuple(r[1]), r[2]) for r in rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, label in kept:
        if i % 50:
            continue
        others = sorted((-dot(v, w), j, k) for j, w, k in kept if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:5]:
            fits = [o for o in others if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s]
            out += [(i, j, n, o[1], -s, -o[0]) for n, o in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(spark, rows):
    got = negatives.mine_table(spark.createDataFrame(rows, VECTORS).repartition(3))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, width=8, centres=6):
    mids = rng.normal(size=(centres, width))
    return [(i, (mids[rng.integers(centres)] + rng.normal(scale=0.5, size=width)).astype(np.float32).tolist(), int(rng.integers(0, 10)), "x", "y") for i in range(n)]


def test_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = vectors(rng, 900)
    hot = rows[5][1]
    rows += [(i, hot, 3, "x", "y") for i in range(900, 1200)]  # a very common vector, anchors with it included
    rows += [rows[50], rows[50], rows[7]]  # repeated rows
    rows += [(1201, None, 1, None, None), (1202, [float("nan")] * 8, 1, None, None), (1250, [1.0] * 7 + [None], 1, None, None), (None, [1.0] * 8, 1, None, None), (1300, [0.5] * 8, None, None, None), (1350, [0.0] * 8, 2, None, None), (1351, [1.0, -1.0], 2, None, None)]
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "SAMPLE", 200)
    got = mined(spark, rows)
    assert got == slow_negatives(rows)
    assert len(got) > 100


def test_negatives_of_few_rows(spark):
    rng = np.random.default_rng(7)
    assert mined(spark, []) == []
    assert mined(spark, vectors(rng, 1)) == []
    few = vectors(rng, 12)
    assert mined(spark, few) == slow_negatives(few)


def test_tree_rules_out_siblings():
    """Clustered vectors: a search leaves subtrees out and loses nothing."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(scale=0.05, size=(4000, 16))))
    length2 = float((v * v).sum(1).max())
    tree = negatives.Tree(16, length2, {}, v[::4], np.zeros(1000, np.int64))
    pending = [((), tree.lift(v[::4]))]
    while pending:
        node, points = pending.pop()
        if len(node) == negatives.LEVELS or len(points) <= negatives.FAN:
            continue
        tree.nodes[node] = split = negatives._spread(points, negatives.FAN)
        branch = negatives.distances(points, split).argmin(1)
        pending += [((*node, k), points[branch == k]) for k in range(len(split))]
    leaves, ways = tree.place(v)
    tree.ranges = {n: np.stack((np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf))) for n, p in tree.nodes.items()}
    for node, k, d in ways:
        tree.ranges[node][0, :, k], tree.ranges[node][1, :, k] = d.min(0), d.max(0)
    visited = 0
    for a in v[:20]:
        s = v @ a
        top = np.sort(s)[-8]
        low, high = np.array([top, 0.5 * top]), np.array([s.max(), 0.55 * top])
        found = set(tree.search(a, low, high))
        visited += len(found)
        need = ((s >= low[0]) & (s <= high[0])) | ((s >= low[1]) & (s <= high[1]))
        assert {leaves[i] for i in np.flatnonzero(need)} <= {negatives._name(f) for f in found}
    assert visited < 0.7 * 20 * len(set(leaves))


def test_scores_stay_exact():
    a = np.array([[2.0**29, 3.0], [1.0, 2.0]])
    assert negatives.scores(a, a).tolist() == [[2**58 + 9, 2**29 + 6], [2**29 + 6, 5]]
    a[0, 0] = 2.0**40
    assert negatives.scores(a, a).tolist() == [[2**62, 2**40 + 6], [2**40 + 6, 5]]
