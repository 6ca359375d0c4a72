"""SimHash near-duplicates and repeated passages against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash, suffixes
from tests.llm.conftest import rows_of, sentence, unique_words


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def slow_components(prints):
    """prints: list of (id, fingerprint); id -> smallest id reachable."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= simhash.DISTANCE:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_fingerprint_matches_definition():
    rng = np.random.default_rng(3)
    for t in [None, "", "  ", "One", "one two", "A b C", "İI ÀÉ x", sentence(rng, 50), "a a a a a a a"]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_groups_match_brute_force(docs_of):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = unique_words(rng, 150)
        for k in range(int(rng.integers(1, 8))):
            copy = list(words)
            for _ in range(k):
                copy[int(rng.integers(len(copy)))] = unique_words(rng, 1)[0]
            texts.append(" ".join(copy))
    got = simhash.near_duplicates(docs_of(texts)).collect()
    want = slow_components([(i, slow_fingerprint(t)) for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["fingerprint"] == format(slow_fingerprint(texts[r["doc_id"]]), "016x") for r in got)
    assert 0 < sum(c != i for i, c in want.items()) < len(want)


def test_tree_finds_every_link():
    rng = np.random.default_rng(9)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    dense = points[:60]
    for _ in range(40):  # a dense ball around a few points
        dense = np.concatenate((dense, dense[rng.integers(0, len(dense), 60)] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))))
    points = np.unique(np.concatenate((points, dense)))
    tree, leaves = simhash.fit_tree(points[::3], len(points), shard=200, leaf_sample=8)
    assert leaves > 4
    shard, row = simhash.shards_of(tree, points)
    root = np.arange(len(points))
    for s in np.unique(shard):
        at = row[shard == s]
        a, b = simhash.forest(points[at])
        root = simhash._merge(root, at[a], at[b])
    want = np.arange(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.DISTANCE)
    want = simhash._merge(want, i, j)
    assert (root == want).all()


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    got = {(r["id"], r["root"]) for r in simhash.star_components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 301)}


def test_near_duplicates_of_awkward_rows(awkward, no_docs):
    got = simhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(r["component_id"])
    assert by_id[0] == by_id[1] == by_id[2] == {0}  # no word: fingerprint zero, linked like any other
    assert by_id[7] == by_id[8] == {7}
    assert by_id[None] == {7, 0}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_keep_one_per_group(awkward, no_docs):
    kept = simhash.keep_one_per_group(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 8 not in ids and 1 not in ids and 2 not in ids
    assert ids.count(7) == 3 and ids.count(None) == 2 and 9 in ids
    assert simhash.keep_one_per_group(no_docs).collect() == []


def slow_repeats(texts):
    """(repeated, removable) masks per text by all runs of MIN_WORDS words."""
    n = suffixes.MIN_WORDS
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    places = defaultdict(list)
    for i, w in words.items():
        for s in range(len(w) - n + 1):
            places[tuple(w[s : s + n])].append((i, s))
    seen = {i: np.zeros(len(w), bool) for i, w in words.items()}
    later = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for at in places.values():
        if len(at) > 1:
            for k, (i, s) in enumerate(sorted(at)):
                seen[i][s : s + n] = True
                if k:
                    later[i][s : s + n] = True
    return seen, later


def masks(rows, texts):
    seen = {i: np.zeros(len((t or "").split()), bool) for i, t in enumerate(texts)}
    later = {i: m.copy() for i, m in seen.items()}
    for r in rows:
        seen[r["doc_id"]][r["start"] : r["end"]] = True
        if r["removed"]:
            later[r["doc_id"]][r["start"] : r["end"]] = True
    return seen, later


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(docs_of, seed):
    rng = np.random.default_rng(seed)
    passages = [unique_words(rng, n) for n in (50, 51, 55, 60, 75, 120, 400)]
    texts = []
    for _ in range(120):
        body = unique_words(rng, int(rng.integers(0, 120)))
        for p in rng.integers(0, len(passages), int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(body) + 1))
            body = body[:at] + passages[p] + body[at:]
        texts.append(" ".join(body).upper() if rng.random() < 0.2 else "  \n".join(body))
    short = unique_words(rng, 49)
    texts += [" ".join(short), " ".join(short), " ".join(unique_words(rng, 3000) + passages[2])]
    got = masks(suffixes.repeated_passages(docs_of(texts)).collect(), texts)
    want = slow_repeats(texts)
    for g, w in zip(got, want):
        assert all((g[i] == w[i]).all() for i in w)
    assert not got[0][len(texts) - 2].any()  # 49 words are too few


def test_hot_passage_over_many_tasks(docs_of, spark):
    """A passage in every text: its suffixes are dealt over all tasks and still meet their neighbours."""
    rng = np.random.default_rng(4)
    hot = unique_words(rng, 70)
    texts = [" ".join(unique_words(rng, 20) + hot + unique_words(rng, 20)) for _ in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = masks(suffixes.repeated_passages(docs_of(texts)).collect(), texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g, w in zip(got, slow_repeats(texts)):
        assert all((g[i] == w[i]).all() for i in w)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partners_apart_in_their_block(docs_of, spark, parts, monkeypatch):
    """Boilerplate of 49 words in many texts, of which some share more words before or after it: whole runs are found,
    whichever texts lie between and however the suffixes are dealt over tasks."""
    if parts == 4:
        monkeypatch.setattr(suffixes, "PART", 300)  # blocks in parts
    rng = np.random.default_rng(parts)
    texts = []
    for shared, copies in ((49, 60), (49, 40), (30, 50), (26, 30), (45, 3), (48, 2)):
        plate, before, after = unique_words(rng, shared), unique_words(rng, 24), unique_words(rng, 24)
        for _ in range(copies):
            a, b = (int(n) for n in rng.integers(0, 25, 2)) if rng.random() < 0.3 else (0, 0)
            texts.append(" ".join(unique_words(rng, 15) + before[24 - a :] + plate + after[:b] + unique_words(rng, 15)))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    plate, extra = unique_words(rng, 49), unique_words(rng, 11)
    texts += [" ".join(unique_words(rng, 19) + (extra if i in (5, 40) else unique_words(rng, 11)) + plate + unique_words(rng, 19)) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = masks(suffixes.repeated_passages(docs_of(texts)).collect(), texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = slow_repeats(texts)
    assert want[1][len(texts) - 20][19:79].all()  # text 40 of the last 60
    for g, w in zip(got, want):
        assert all((g[i] == w[i]).all() for i in w)


def test_every_window_has_a_retained_position():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    at = suffixes.retained(suffixes.Rolling(words, suffixes.Powers()), len(words))
    inner = at[at <= len(words) - suffixes.MIN_WORDS]
    assert np.diff(inner).max() <= suffixes.WINDOW and inner[0] < suffixes.WINDOW
    assert len(at) < len(words) / 8


def test_remove_repeats(docs_of, awkward, no_docs):
    rng = np.random.default_rng(6)
    hot = " ".join(unique_words(rng, 60))
    texts = [f"first  one\n{hot} end", f"start {hot}\n\tlast  two ", "clean   text\n", hot]
    kept = suffixes.remove_repeats(docs_of(texts))
    assert kept.columns == docs_of(texts).columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert got == {0: texts[0], 1: "start last  two ", 2: texts[2]}  # the last text is nothing but a repeat
    rows = suffixes.remove_repeats(awkward).collect()
    ids = [r["doc_id"] for r in rows]
    assert 8 not in ids and ids.count(None) == 1 and {0, 1, 2, 9} <= set(ids)
    assert suffixes.remove_repeats(no_docs).collect() == [] and suffixes.repeated_passages(no_docs).collect() == []


def test_null_id_keeps_its_place(docs_of):
    rng = np.random.default_rng(7)
    hot = " ".join(unique_words(rng, 80))
    rows = rows_of([hot])
    rows.append((None, hot + " more", None, None, None, None, None, None, None, None))
    got = {(r["doc_id"], r["removed"]) for r in suffixes.repeated_passages(docs_of(rows)).collect()}
    assert got == {(0, False), (None, True)}


def test_copies_of_a_row_leave_one_whole(awkward, docs_of):
    """Copies of id 7, and of rows without an id, are not taken for repeats of themselves."""
    same = next(r["text"] for r in awkward.where("doc_id = 7").collect())
    assert [r["text"] for r in suffixes.remove_repeats(awkward).collect() if r["doc_id"] == 7] == [same]
    rng = np.random.default_rng(12)
    a, b, c = (" ".join(unique_words(rng, 80)) for _ in range(3))
    rows = [(i, t, *[None] * 8) for i, t in [(1, a), (1, a), (None, b), (None, b), (None, b), (2, c), (None, f"{c} {a}"), (5, "few words"), (5, "few words")]]
    got = sorted((r["doc_id"] or 0, r["start"], r["end"], r["removed"]) for r in suffixes.repeated_passages(docs_of(rows)).collect())
    assert got == [(0, 0, 80, False), (0, 0, 80, True), (0, 0, 80, True), (0, 0, 160, True), (1, 0, 80, False), (2, 0, 80, False)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in suffixes.remove_repeats(docs_of(rows)).collect())
    assert left == sorted([(0, b), (1, a), (2, c), (5, "few words"), (5, "few words")])
