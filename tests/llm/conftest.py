from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

EXTRA = ["kept", "score", "n_lines", "spans", "key", "id", "label", "length"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in EXTRA)])


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrstdé") for _ in range(rng.randint(2, 7))) for _ in range(n))


#: Nulls, empty and blank texts, a very long one, ties, repeated rows.
EDGES = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "  \n\t ", None, None), (None, prose(1, 40), "en", "s2"), (None, None, None, None),
    (4, prose(2, 60), "en", "s1"), (4, prose(2, 60), "en", "s1"), (5, prose(2, 60), "fr", "s2"), (6, "one two", "en", "s2"), (7, "One  TWO", "de", "s1"),
    (8, prose(3, 30_000), "en", "s1"), (9, "x" * 200_000, "en", "s2"), (10, "1.2.3." * 20_000, "en", "s2"), (11, "a@" * 30_000 + "b.c" + ".d" * 30_000, "en", "s1"),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) as ``documents`` with extra columns of clashing names."""

    def make(rows):
        full = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGES)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
