import sys

import pytest
from pyspark.sql import functions as F  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, optionally with a source; extra columns with names that operators use inside."""

    def make(rows, source=None):
        full = [(i, t, None, source(i) if source else "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS words", "'x' AS fp", "2 AS spans", "3 AS gram", "4 AS th", "5 AS word", "6 AS component_id", "7 AS base_failed", "8 AS p", "9 AS n", "10 AS n_words", "11 AS host_rate", "12 AS _hit")

    return make


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (6, "Été " * 3000), (7, "x" * 30000), (8, "a b c\na b c\n\na b c"), (None, "one two three four"), (9, "password = \"abcdef0123456789abcdef\"")]


@pytest.fixture(scope="session")
def edge():
    return EDGE
