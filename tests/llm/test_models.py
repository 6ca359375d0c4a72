"""Trained operators: held-out accuracy on the given tables, properties, awkward rows; and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontam, langid, quality, simhash, suffixes, toxicity
from barloom.llm.queries import QUERIES, table
from tests.llm.conftest import rows_of, sentence, unique_words

SF = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def truth(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}


def accuracy(rows, truth, label, held):
    own = [(r["predicted"], truth[r["doc_id"]][label]) for r in rows if r["doc_id"] in truth and r["held_out"] == held]
    return float(np.mean([p == y for p, y in own]))


def test_quality_on_held_out_rows(spark, truth):
    rows = QUERIES["op6_quality_classifier"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in rows)
    assert accuracy(rows, truth, "quality", True) > 0.95


def test_discriminant_matches_densities():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (400, 4)), rng.normal(0.5, 2, (300, 4))
    n = np.array([len(a), len(b)], float)
    model = quality.QuadraticDiscriminant.from_sums(n, np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]))
    x = rng.normal(0, 2, (20, 4))
    want = []
    for k in (0, 1):
        low = np.linalg.inv(model.inverse_factors[k])
        cov = low @ low.T
        z = x - model.means[k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(n[k]))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(want[0] - want[1])))
    assert quality.QuadraticDiscriminant.from_sums(np.array([0.0, 3.0]), np.zeros((2, 4)), np.zeros((2, 4, 4))) is None


def test_held_out_labels_have_no_influence(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r["doc_id"]: r["score"] for r in quality.score_quality(docs, x).collect()} for x in (labels, turned)]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-6 for k in scores[0])


def test_quality_of_awkward_rows(awkward, no_docs, labels_of):
    labels = labels_of([(i, i % 2, 0) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 7, 7), (5, 0, 0)])
    rows = quality.score_quality(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    scores = quality.score_quality(awkward, labels)
    assert kept.count() == scores.where("score >= 0.3").count()
    nothing = labels_of([])
    assert {r["score"] for r in quality.score_quality(awkward, nothing).collect()} == {0.5}
    assert quality.keep_good(awkward, nothing).count() == awkward.count()
    assert quality.score_quality(no_docs, labels).collect() == [] and quality.keep_good(no_docs, labels).collect() == []


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == 1000 and np.mean(held) > 0.97
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_word_first_backoff():
    counts = [("a", 0, "hello", 90), ("b", 0, "hello", 10), ("a", 0, "zz", 10), ("b", 0, "zz", 90), ("a", 5, "x", 10), ("b", 5, "y", 10), ("b", 4, "^y", 4), ("a", 4, "^x", 4)]
    model = langid.Backoff.from_counts(counts)
    assert model.langs == ["a", "b"]
    assert model.word("hello")[0] > 0  # a known word never asks its n-grams
    assert model.word("yz")[1] > model.word("yz")[0] and model.word("xz")[0] > model.word("xz")[1]
    known = model.word("xz")[0]
    assert 0 < known < abs(model.levels[4]["^x"][0] - model.levels[4]["^x"].mean())  # weighted down
    assert (model.word("qqq") == 0).all()
    assert langid.grams_of("ab", 5) == [] and langid.grams_of("ab", 3) == ["^ab", "ab$"] and langid.grams_of("ab", 1) == ["a", "b"]


def test_language_of_awkward_rows(awkward, no_docs, docs_of):
    model = langid.learn(awkward)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    got = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2, 5, 6):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[9]["lang_pred"] in ("de", "en") and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.learn(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(awkward, None).collect()} == {"und"}
    assert langid.identify(no_docs, model).collect() == []


def test_toxicity_on_held_out_rows(spark, truth):
    rows = QUERIES["op9_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert accuracy(rows, truth, "toxic", True) > 0.9


def test_toxic_words_are_found_however_they_are_written():
    kinds = toxicity.Kinds({"grumpf-": 3.0})
    for w in ("idiot", "IDIOT!!", "1d1ot", "id!ot,", "i.d.i.o.t", "idioooot", "idiots"):
        assert kinds[w] & toxicity.INSULT, w
    assert kinds["1d1ot"] & toxicity.HIDDEN and kinds["idioooot"] & toxicity.STRETCHED and kinds["You,"] & toxicity.YOU
    assert not kinds["idiom"] & toxicity.INSULT and kinds[""] == 0
    assert not kinds["y0u"] & toxicity.YOU
    assert kinds["grumpfig"] >> 8 == 48 and kinds["grump"] >> 8 == 0


def test_second_person_is_near_only_within_the_window():
    kinds, at = toxicity.Kinds(), toxicity.FEATURES.index("near_you")
    near = toxicity.features("you are an idiot", kinds)[at]
    far = toxicity.features("you " + "word " * 10 + "idiot", kinds)[at]
    assert near > 0 and far == 0 and toxicity.features(None, kinds) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_of_awkward_rows(awkward, no_docs, docs_of, labels_of):
    rng = np.random.default_rng(2)
    texts = [sentence(rng, 60) + (" you stupid idiot, you loser" if i % 2 else "") for i in range(120)]
    labels = labels_of([(i, 1, i % 2) for i in range(120)] + [(5, None, None), (None, 1, 1)])
    both = docs_of(rows_of(texts)).unionByName(awkward)
    rows = toxicity.score_toxicity(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] >= 20]
    assert np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in own]) > 0.95
    assert {r["score"] for r in toxicity.score_toxicity(awkward, labels_of([])).collect()} == {0.0}
    assert toxicity.score_toxicity(no_docs, labels).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Every stage by its own operator, each on what the one before kept."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(d.columns == columns for d in seen[:-1])
    good, unique, cut, clean, packed = seen[1:]
    before = {r["doc_id"]: r["text"] for r in good.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, table(spark, SF, "labels")).collect()}
    assert set(before) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    prints = simhash.near_duplicates(good).collect()
    assert {r["doc_id"] for r in unique.collect()} == {r["component_id"] for r in prints}
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    removed = {r["doc_id"] for r in suffixes.repeated_passages(unique).where("removed").collect()}
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert removed and all(after[i] == t for i, t in texts.items() if i not in removed)
    assert all(len(after.get(i, "")) < len(texts[i]) for i in removed)
    leaks = {r["doc_id"] for r in decontam.find_leaks(cut, table(spark, SF, "benchmark")).collect()}
    left = {r["doc_id"] for r in clean.collect()}
    assert leaks and left == set(after) - leaks
    assert {r["doc_id"] for r in packed.collect()} == left


def test_stages_on_awkward_rows(spark, awkward, no_docs, tmp_path, labels_of):
    bench = spark.createDataFrame([(1, " ".join(unique_words(np.random.default_rng(3), 20)))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels_of([(i, i % 2, 0) for i in range(12)]).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (awkward, no_docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        corpus_pipeline.run(spark, str(tmp_path)).collect()
