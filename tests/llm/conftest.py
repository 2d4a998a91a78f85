from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows, source="src0"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, 0, None, -1, "x") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, label int, id long, key string"
        )

    return make


LONG = "word " * 30_000
EDGE_ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, ""),
    (4, None),
    (5, LONG),
    (6, LONG + "end"),
    (None, "one two three four five six seven eight nine ten"),
    (7, "single"),
    (8, "é \U0001f600 \t\n x"),
]


@pytest.fixture
def edges(docs):
    return docs(EDGE_ROWS)


@pytest.fixture
def nothing(docs):
    return docs([])
