import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (id, text) or (id, text, source) rows, with
    extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", 1.0, [1]) for r in rows]
        return spark.createDataFrame(full, DOCS + ", spans string, size double, h array<int>")

    return make
