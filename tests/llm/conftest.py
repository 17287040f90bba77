from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _copy string"


@pytest.fixture
def docs_of(spark):
    """Documents table of texts, or of (id, text) pairs, with one column more."""

    def make(items):
        pairs = [i if isinstance(i, tuple) else (k, i) for k, i in enumerate(items)]
        rows = [(k, t, "en", None, None if t is None else len(t), "x") for k, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
