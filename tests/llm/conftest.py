import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: documents with columns whose names the operators use themselves
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, k_id string, k_tie string, "
    "row string, body string, n int, s int, slot int"
)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a table with clashing extra columns."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            chars = None if text is None else len(text)
            full.append((doc_id, text, lang, source, chars, "x", "y", "z", "b", 1, 2, 3))
        return spark.createDataFrame(full, DOCS)

    return make
