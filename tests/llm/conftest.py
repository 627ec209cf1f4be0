"""Small tables of documents, odd ones among them."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def of(rows, more=None):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCUMENT)
        return df

    return of


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empties, ties, repeated rows, a very long text."""
    return make([(1, None), (2, ""), (None, "alone here"), (3, "Same text"), (4, "same TEXT"), (4, "same TEXT"), (5, "long " * 60_000), (6, "x"), (7, None, None), (8, "éÉ 😀 ß́ \x1c tab\tend"), (9, "y" * 200_000)])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns whose names the operators might use."""
    from pyspark.sql import functions as F

    return odd.withColumns({x: F.lit(7) for x in ("rid", "_rid", "kept", "score", "sha", "key", "maybe", "bands", "block", "n", "ids", "x", "item_id", "a b.c")})
