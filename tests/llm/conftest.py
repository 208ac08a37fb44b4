from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, id long, rank int, kept string, n_removed long, digest string, key long"


@pytest.fixture()
def documents(spark):
    """Builds documents from texts, or (id, text, source); with further columns whose names clash with the operators' own."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, "s")
            full.append((doc_id, text, "en", source, len(text) if text is not None else None, 0.5, 3, 4, None, "k", 5, "d", 6))
        return spark.createDataFrame(full, SCHEMA)

    return build
