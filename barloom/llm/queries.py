"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, langid, lempelziv, merkle, negatives, packing, quality, rules, simhash, suffixes, tokencount, toxicity, urls
from barloom.llm.common import id_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def token_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), token_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Host and path rules of the URL filter query.
RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@query("op5_url_filters")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rules_sql() -> str:
    """Operator 10 in SQL, written from its definition."""
    quoted = lambda words: ", ".join("'" + w + "'" for w in words)
    forms = sorted({f for ws in rules.COMMON_WORDS.values() for w in ws for f in (w, w.capitalize(), w.upper())})
    space = r"[\x20\x09-\x0D]+"
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "mark": r"""[.,;:!?''"()-]""", "symbol": "[#*$%&|<>]"}
    counted = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) as c_{n}" for n, p in classes.items())
    names = [*classes, "rest"]
    term = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
    parts = " + ".join(f"0.5 * ({term(f'p_{n}', f'q_{n}')} + {term(f'q_{n}', f'p_{n}')})" for n in names)
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as materialized (select doc_id, lang, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') as ws,
  length(regexp_replace(t, '{space}', '', 'g')) as word_chars, {counted} from d),
n as materialized (select *, len(ws) as n_words, word_chars - ({" + ".join("c_" + c for c in classes)}) as c_rest from w),
win as (select doc_id, i, list_slice(ws, i, i + 4) as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from twice) group by doc_id),
dup as (select doc_id, count(*) - count(distinct l) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as l from w)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
share as materialized (select doc_id, lang, {", ".join(f"c_{c} / greatest(word_chars, 1) as p_{c}" for c in names)}, word_chars from n),
langs as (select lang, {", ".join(f"avg(p_{c}) filter (where word_chars > 0) as q_{c}" for c in names)} from share where lang is not null group by lang),
word as materialized (select doc_id, lang, lower(x) as word, count(*) as k from (select doc_id, lang, unnest(ws) as x from w) where x in ({quoted(forms)}) group by doc_id, lang, lower(x)),
p as (select doc_id, word, k / sum(k) over (partition by doc_id) as p from word),
q as (select lang, word, sum(k) / sum(sum(k)) over (partition by lang) as q from word where lang is not null group by lang, word),
cd as (select s.doc_id, l.lang, sqrt(greatest(0, {parts})) as c from share s cross join langs l),
wd as (select doc_id, lang, sqrt(greatest(0, sum(0.5 * ({term("p", "q")} + {term("q", "p")})) + 0.5 * greatest(0, 1 - sum(q)))) as x
  from (select p.doc_id, l.lang, p.p, coalesce(q.q, 0) as q from p cross join langs l left join q on q.lang = l.lang and q.word = p.word) group by doc_id, lang),
far as (select cd.doc_id, cd.lang, c, coalesce(x, case when cd.lang in (select lang from q) then 1 else 0 end) as x from cd left join wd using (doc_id, lang)),
near as (select doc_id, bool_or((n.word_chars < {rules.MIN_CHARS} or c <= {rules.CLASS_LIMIT}) and (n_words < {rules.MIN_WORDS} or coalesce(x, 0) <= {rules.WORD_LIMIT})) as near
  from far join n using (doc_id) group by doc_id),
base as (select doc_id, n_words, n.word_chars, c_symbol as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from n left join dup using (doc_id) left join rep using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(near, true) as kept
from base left join near using (doc_id)
"""


ORACLES["op10_quality_rules"] = rules_sql()


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_documents(table(spark, sf_dir, "documents"))


#: Levels of the trees that the SQL writes out; FAN ** SQL_LEVELS leaves a language.
SQL_LEVELS = 8


def merkle_sql() -> str:
    """Operator 11 in SQL: the trees level by level, every way folded from its leaf."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {part(text)})"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bits = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint))), lambda a, c: {bits.format(x='xor(a, c)')}))"
    ctes = [
        f"l0 as materialized (select doc_id, lang, {leaf('text')} as leaf, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} end as now from documents)",
        "n0 as materialized (select doc_id, lang, leaf, coalesce(now, leaf) as now, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from l0)",
        "t0 as materialized (select lang, pos, leaf as h, count(*) over (partition by lang) as n from n0)",
    ]

    def tower(t: str, levels: int) -> None:
        for k in range(levels):
            ctes.append(
                f"{t}{k + 1} as materialized (select lang, p as pos, h, count(*) over (partition by lang) as n from (select lang, case when n = 1 then pos else pos // 8 end as p, "
                f"case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by pos)) end as h from {t}{k} group by lang, n, case when n = 1 then pos else pos // 8 end))"
            )

    def fold(f: str, t: str, levels: int, key: str) -> None:
        """Rows (id, key, pos, h, proof) carried up: their siblings on both sides and the hash with them."""
        for k in range(levels):
            ctes.append(
                f"{f}{k + 1} as materialized (select f.id, f.lang, case when max(t.n) = 1 then max(f.pos) else max(f.pos) // 8 end as pos, "
                f"case when max(t.n) = 1 then max(f.h) else sha256(coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos < f.pos), '') || max(f.h) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos > f.pos), '')) end as h, "
                f"max(f.proof) || coalesce(string_agg(t.h, '' order by t.pos) filter (where t.pos <> f.pos), '') as proof "
                f"from {f}{k} f join {t}{k} t on f.lang is not distinct from t.lang and t.pos // 8 = f.pos // 8 group by f.id, f.lang)"
            )

    tower("t", SQL_LEVELS)
    ctes.append("f0 as materialized (select row_number() over () as id, lang, pos, now as h, '' as proof, doc_id, leaf from n0)")
    ctes.append(f"s as materialized (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos from t{SQL_LEVELS})")
    ctes.append("u0 as materialized (select 0 as lang, pos, subroot as h, count(*) over () as n from s)")
    tower("u", 3)
    fold("f", "t", SQL_LEVELS, "lang")
    ctes.append(f"g0 as materialized (select f.id, 0 as lang, s.pos, f.h, f.proof from f{SQL_LEVELS} f join s on f.lang is not distinct from s.lang)")
    fold("g", "u", 3, "0")
    return "with " + ",\n".join(ctes) + """
select f0.doc_id, f0.leaf, s.subroot, (select h from u3) as root, sha256(g3.proof) as proof_sha256, g3.h as folded_root, g3.h = (select h from u3) as verified
from f0 join g3 on f0.id = g3.id join s on f0.lang is not distinct from s.lang"""


ORACLES["op11_merkle_manifest"] = merkle_sql()


@query("op12_substring_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lempelziv.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op12_substring_dedup"] = r"""
with d as materialized (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as materialized (select doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 12), ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as first from w) where first < doc_id),
c as (select doc_id, list_sort(list_distinct(flatten(list(range(i, i + 13))))) as gone from r group by doc_id),
k as (select d.doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
  case when gone is null then ws else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(gone, x[2])), lambda x: x[1]) end as kept
  from d left join c using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256 from k
"""


@query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_table(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
with e as materialized (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.id as anchor_id, b.id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.id % 50 = 0 and a.id <> b.id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as integer) as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= 3
"""
