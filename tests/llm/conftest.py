from __future__ import annotations

import pytest

from flowloom.llm.catalog import ready


@pytest.fixture(scope="session", autouse=True)
def ready_session(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def texts_of(spark):
    """A table (doc_id, text) of texts in the order given, or of (id, text) pairs."""

    def make(texts):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    return make


ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\t \n",
    "word",
    "one two  three\nfour",
    "é ü ß 漢字 😀",
    "don't can't 123 4.5",
    "a" * 5000,
    "ab " * 4000,
]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
