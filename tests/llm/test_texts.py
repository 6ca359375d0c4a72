"""Operators on single texts: packing, token counts, quality rules, URL filter, decontamination."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import decontam, packing, rules, tokencount, urls
from barloom.llm.queries import RULES, token_path
from tests.llm.conftest import rows_of, sentence, unique_words


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_path())


def check_pieces(rows, limits=packing.Limits()):
    """Pieces are gapless in their sequences, within the limits, and whole per document; ids by document row."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return by_doc, padding


WORDS = ["don't", "it's", "x<|endoftext|>y", "naïve", "NAÏVE", "e\u0301", "ﬁ", "İstanbul", "ΣΑΣ", "中文字", "a1b2", "..!?", "end.", "(mail@x.org)", "ß", "\u00a0", "a\u00a0b", "\x1f", "a\x1fb", "it'll%%%", "<|startoftext|>", "ﷺ", "🙂🙂", "_x_", "ñandú&&&", "x'S"]


def test_words_give_the_ids_of_the_whole_text(tokenizer):
    rng = np.random.default_rng(2)
    words = packing.WordTokens(token_path())
    for _ in range(300):
        text = "".join(w + sep for w, sep in zip(rng.choice(WORDS + unique_words(rng, 20), 30), rng.choice([" ", "\n", "  ", "\t", "\r\n", "\x0b"], 30)))
        assert words.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs_of, tokenizer):
    rng = np.random.default_rng(3)
    texts = [sentence(rng, int(rng.integers(0, 400))) for _ in range(200)] + [sentence(rng, 12_000), None, ""]
    by_doc, padding = check_pieces(packing.pack(docs_of(texts), token_path()).collect())
    assert padding == 0
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) for r in pieces)


def test_packing_under_all_three_limits(docs_of):
    rng = np.random.default_rng(4)
    rows = rows_of([sentence(rng, int(rng.integers(0, 300))) for _ in range(300)])
    docs = docs_of([(*r[:5], sentence(rng, int(rng.integers(0, 200))) if r[0] % 2 else None, *r[6:]) for r in rows])
    limits = packing.Limits(tokens=512, segments=5, loss=300)
    rows = packing.pack(docs, token_path(), limits=limits, prompt="score").collect()
    by_doc, _ = check_pieces(rows, limits)
    assert len(by_doc) == 300
    for pieces in by_doc.values():
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


def test_dot_product_prefers_what_is_plentiful():
    packer = packing.Packer(packing.Limits(tokens=100, segments=4, loss=10), 0)
    ids = np.arange(60, dtype="<u4")
    list(packer.add(1, ids[:50], 45))  # many tokens, little loss
    list(packer.add(2, ids[:12], 2))  # few tokens, all the loss
    list(packer.add(3, ids[:40], 35))
    rows = list(packer.finish())
    first = [r[0] for r in rows if r[4] == rows[0][4]]
    assert rows[0][0] == 1 or {1, 3} & set(first)
    assert sum(r[2] for r in rows) == 102


def test_packing_awkward_rows(awkward, no_docs, tokenizer):
    rows = packing.pack(awkward, token_path()).collect()
    _, padding = check_pieces(rows)
    assert padding == 0
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(r["length"] for r in rows) == want
    assert packing.pack(no_docs, token_path()).collect() == []


def slow_tokens(model, word):
    """Best segmentation of a word by plain dynamic programming: (score, tokens)."""
    word = tokencount.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * model.byte, -(best[end - 1][1] + n))]
        for at in range(end):
            p = model.scores.get(word[at:end])
            if p is not None:
                options.append((best[at][0] + p, -(best[at][1] + 1)))
        s, t = max(options)
        best.append((s, -t))
    return best[-1]


def test_token_counts_match_plain_search(awkward, docs_of, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = tokencount.load_unigram(path)
    rng = np.random.default_rng(5)
    for docs in (awkward, docs_of([sentence(rng, 80), "Ünïcode 🙂 中文 " + " ".join(unique_words(rng, 50)), "the then them there"])):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(r["text"])
        got = tokencount.count_tokens(docs, path).collect()
        assert len(got) == docs.count()
        seen = defaultdict(list)
        for r in got:
            seen[r["doc_id"]].append((r["n_words"], r["n_tokens"], round(r["log_score"], 4)))
        for i, ts in texts.items():
            want = []
            for t in ts:
                words = [w.decode() for w in (t or "").encode().split()]
                found = [slow_tokens(model, w) for w in words if len(w) < 200]
                if len(found) == len(words):
                    want.append((len(words), sum(f[1] for f in found), round(sum(f[0] for f in found), 4)))
            if len(want) == len(ts):
                assert [x[:2] for x in sorted(seen[i])] == [x[:2] for x in sorted(want)]
                assert np.allclose([x[2] for x in sorted(seen[i])], [x[2] for x in sorted(want)], atol=1e-3)
    assert tokencount.count_tokens(no_docs, path).collect() == []


def test_trie_shares_prefixes():
    trie = tokencount.Trie(tokencount.Unigram({"a": -1.0, "ab": -1.5, "b": -1.0}, 2, -9.0))
    assert trie.tokens[trie.terminal("abab")] == 2 and len(trie) == 5
    trie.terminal("abaa")
    assert len(trie) == 6


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def slow_distance(p, q):
    keys = set(p) | set(q)
    js = 0.0
    for k in keys:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        js += 0.5 * (a * np.log2(2 * a / (a + b)) if a else 0) + 0.5 * (b * np.log2(2 * b / (a + b)) if b else 0)
    return float(np.sqrt(max(0.0, js)))


def test_text_without_common_words_is_far(docs_of):
    """Words alone, none of them a function word, pass only where no reference has any or the text is short."""
    rng = np.random.default_rng(16)
    junk = [" ".join("".join(rng.choice(list("bcdfghklmnprstaeiou"), 5)) for _ in range(n)) for n in (200, 40)]
    texts = [sentence(rng, 200) for _ in range(20)] + junk
    got = {r["doc_id"]: r for r in rules.apply_rules(docs_of(texts)).collect()}
    assert got[20]["word_distance"] == 1 and not got[20]["kept"] and not got[20]["base_failed"]
    assert got[21]["kept"] and all(got[i]["kept"] for i in range(20))
    assert all(r["kept"] and r["word_distance"] == 0 for r in rules.apply_rules(docs_of(junk)).collect())


def test_rules_match_brute_force(docs_of, awkward, no_docs):
    rng = np.random.default_rng(6)
    base = sentence(rng, 30)
    texts = [sentence(rng, 200) for _ in range(20)]
    texts += [sentence(rng, 100).upper(), " ".join(w + "%%%" for w in sentence(rng, 100).split()), f"{base}\n{base}\n x\n{base}", "a b c d e a b c d e f", "tiny", None, ""]
    docs = docs_of(texts)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs).collect()}
    shares, words = [], Counter()
    known = {w for ws in rules.COMMON_WORDS.values() for w in ws}
    forms = {f for w in known for f in (w, w.capitalize(), w.upper())}
    classes, found = {}, {}
    for i, t in enumerate(texts):
        left, c = t or "", {}
        for name, pattern in rules.CLASSES.items():
            rest = re.sub(pattern, "", left)
            c[name], left = len(left) - len(rest), rest
        del c["space"]
        c["rest"] = len(left)
        classes[i] = {k: v / max(1, sum(c.values())) for k, v in c.items()}
        if sum(c.values()):
            shares.append(classes[i])
        found[i] = Counter(w.lower() for w in (t or "").split() if w in forms)
        words.update(found[i])
    mean = {k: np.mean([s[k] for s in shares]) for k in shares[0]}
    common = {w: n / words.total() for w, n in words.items()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == slow_base(t)
        a = slow_distance(classes[i], mean)
        b = slow_distance({w: n / found[i].total() for w, n in found[i].items()}, common) if found[i] else 1.0
        if t:
            assert abs(r["class_distance"] - a) < 1e-9
        assert abs(r["word_distance"] - b) < 1e-9
        if not r["base_failed"]:
            assert r["kept"] == ((r["word_chars"] < rules.MIN_CHARS or a <= rules.CLASS_LIMIT) and (r["n_words"] < rules.MIN_WORDS or b <= rules.WORD_LIMIT))
    assert not got[20]["kept"] and got[0]["kept"]
    rows = rules.apply_rules(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        text = next(x["text"] for x in awkward.where(f"doc_id = {r['doc_id']}").collect())
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == slow_base(text)
    assert rules.apply_rules(no_docs).collect() == []


def test_every_language_is_a_reference(spark, monkeypatch):
    texts = {"en": "the cat and the dog are in the house of a man ", "de": "der hund und die katze ist in dem haus ", "fr": "le chat et les chiens dans la maison ", "xx": "1234 5678 90 12 ", "yy": "QWER TY UIOP "}
    rows = [(10 * i + j, text * (6 + j), lang) for i, (lang, text) in enumerate(texts.items()) for j in range(i + 1)] + [(98, "QWER ASDF " * 60, None), (99, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    columns = ("doc_id", "kept", "base_failed", "class_distance", "word_distance")
    judge = lambda: {r["doc_id"]: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rules.apply_rules(docs).collect()}
    whole = judge()
    for held in (1, 3):
        monkeypatch.setattr(rules, "LANGUAGES", held)
        assert judge() == whole



def test_rules_use_no_python(docs_of):
    plan = rules.document_counts(docs_of(["a b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


URLS = [
    ("http://A.org/x", "a.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://www.Example.org/en/12?x=/es/", "www.example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("ftp://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    ("x://b.com/de/#top", "b.com", "/de/", "com/de/", "block"), ("http://b.com/fr", "b.com", "/fr", None, None), ("http://org", "org", "", None, None),
    ("http://org/", "org", "/", "org/", "allow"), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("://", "", "", None, None),
    ("http://?q", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://ÄB.com/de/é?x", "Äb.com", "/de/é", "com/de/", "block"),
    ("http://x.y#a/b?c", "x.y", "", None, None), ("http://cheapcasino.net/win", "cheapcasino.net", "/win", None, "block"), ("http://news.sciencejournal.net/history", "news.sciencejournal.net", "/history", None, "allow"),
]


def test_urls(spark):
    rows = [(i, u[0], "<p>cheap casino science journal history and the news</p>" if i % 2 else None, "v") for i, u in enumerate(URLS)]
    rows += [rows[0], (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").repartition(3)
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            _, host, path, rule, verdict = URLS[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
            assert rule or r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")
    assert urls.judge(pages.limit(0), RULES).collect() == []


def test_segmentation_is_the_best_split():
    s = urls.Segmenter({"new": 50, "york": 40, "newy": 1, "times": 30, "ork": 1})
    assert s.split("newyorktimes") == ["new", "york", "times"] and s.split("") == []
    assert s.tokens("new-york9times.com") [:2] == ["new", "york"]

    def cost(parts):
        return sum(s.logs.get(w, s.unknown - len(w) * np.log(10.0)) for w in parts)

    name = "yorknewtimesx"
    splits = [[name[a:b] for a, b in zip([0, *cuts], [*cuts, len(name)])] for m in range(2 ** (len(name) - 1)) for cuts in [[i + 1 for i in range(len(name) - 1) if m >> i & 1]]]
    assert abs(max(map(cost, splits)) - cost(s.split(name))) < 1e-9


def test_leaks(spark, docs_of, awkward, no_docs):
    rng = np.random.default_rng(7)
    items = [unique_words(rng, n) for n in (15, 20, 30, 56, 100)]
    rare = unique_words(rng, 400)
    noise = lambda n: " ".join(rng.choice(rare, n).tolist())
    texts, want = [noise(int(rng.integers(20, 300))) for _ in range(40)], set()
    for k, item in enumerate(items):
        changed = [w if i % 4 else "other" for i, w in enumerate(item)]  # every fourth word replaced: still 75 %
        for body in (item, [w.upper() + "!!" for w in item], changed):
            want.add((len(texts), k))
            texts.append(noise(int(rng.integers(0, 200))) + " " + " ".join(body) + "\n" + noise(50))
    half = items[3][:20]
    texts.append(noise(60) + " " + " ".join(half) + " " + noise(60))  # a third of an item is no leak
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    got = decontam.find_leaks(docs_of(texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    clean = {r["doc_id"] for r in decontam.drop_leaks(docs_of(texts), bench).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}
    kept = decontam.drop_leaks(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert decontam.find_leaks(no_docs, bench).collect() == [] and decontam.find_leaks(awkward, bench.limit(0)).collect() == []


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 30).tolist()
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        table = np.zeros((13, 31), int)
        for i in range(12):
            for j in range(30):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_subsequence(masks, 12, b) == table[-1, -1]


def test_svd_spans_the_passages(spark):
    rng = np.random.default_rng(9)
    items = decontam.Items.of([(i, unique_words(rng, 20)) for i in range(12)])
    weight = np.concatenate(([0.0], rng.random(len(items.vocabulary)) + 0.5))
    v = decontam.randomised_svd(spark, items, weight, rank=12)
    a = np.zeros((12, len(weight)))
    for i, p in items.passages():
        at, x = decontam._vector(p, weight)
        a[i, at] = x
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-8) and np.allclose(a @ v @ v.T, a, atol=1e-6)


@pytest.mark.parametrize("share", [3, 10, 1])
def test_partial_leak_in_many_documents(docs_of, spark, share):
    """Most words of an item in a third, a tenth or all of the documents are common words and still a leak."""
    rng = np.random.default_rng(21)
    item = unique_words(rng, 30)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(unique_words(rng, 40)))], "item_id long, text string")
    copy = list(item)
    for k in (3, 11, 19, 27):
        copy[k] = unique_words(rng, 1)[0]
    texts = [" ".join(unique_words(rng, 60) + (copy if i % share == 0 else []) + unique_words(rng, 50)) for i in range(60)]
    texts.append(" ".join(unique_words(rng, 30) + item + unique_words(rng, 30)))
    want = {(i, 0) for i in range(60) if i % share == 0} | {(60, 0)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs_of(texts), bench).collect()} == want
    assert {r["doc_id"] for r in decontam.drop_leaks(docs_of(texts), bench).collect()} == set(range(61)) - {i for i, _ in want}
