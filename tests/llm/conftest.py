from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, size long, bytes long"


@pytest.fixture
def docs(spark):
    """(id, text) pairs as documents with columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", 0, "k", 1, 2, 3) for i, t in rows], DOC)

    return make


@pytest.fixture
def odd(docs):
    """Null and empty texts, null and repeated ids, blanks, a very long text, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return docs([(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "one two three four five six"), (5, long), (5, long), (6, long + " tail"), (7, "ÉÈ ß 漢字 tests ok"), (None, None)])
