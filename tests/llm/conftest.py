from __future__ import annotations

import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def build(rows):
        data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(data, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, n INT")

    return build
