import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a documents table from texts, or from (doc_id, text) pairs."""

    def make(texts, extra=False):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        if not extra:
            return spark.createDataFrame(rows, DOC)
        return spark.createDataFrame([(*r, "x", 1.5) for r in rows], DOC + ", kept string, component_id double")

    return make

