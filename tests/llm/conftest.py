import string

import numpy as np
import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # extra columns whose names clash with those the operators use or return
        T.StructField("score", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("__fp", T.IntegerType()),
        T.StructField("doc", T.IntegerType()), T.StructField("a.b", T.IntegerType()),
    ]
)
LABEL_SCHEMA = "doc_id long, quality int, toxic int"


def sentence(rng, n, words=None):
    words = words or [w for w in ("the of and to in a is that for it with as was on be at by this from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know").split()]
    return " ".join(rng.choice(words, n).tolist())


def unique_words(rng, n):
    letters = np.array(list(string.ascii_lowercase))
    return ["".join(rng.choice(letters, 7)) for _ in range(n)]


def rows_of(texts, lang="en"):
    return [(i, t, lang, "s", len(t or ""), "x", "y", 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(texts_or_rows, parts=3):
        rows = texts_or_rows if texts_or_rows and isinstance(texts_or_rows[0], tuple) else rows_of(texts_or_rows)
        return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls in every column, empty and blank texts, ties, repeated rows, one very long text, marks and other scripts."""
    rng = np.random.default_rng(1)
    long = " ".join(unique_words(rng, 20_000))
    same = sentence(rng, 120)
    texts = [None, "", " \n\t ", "word", "Ünïcode ß 中文 éà", "!!! ??? ###", "1 2 3", same, same, long, sentence(rng, 60), "a\x00b c d  e", "x" * 5000]
    rows = rows_of(texts)
    rows += [rows[7], rows[7]]  # repeated rows
    rows += [(None, same, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(3, "another text of an id that is taken", "de", None, 1, None, None, None, None, None)]
    return docs_of(rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, LABEL_SCHEMA)
