from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def docs(*rows, extra: bool = False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return df.selectExpr("*", "'x' AS part", "1 AS `row`", "array(1) AS tokens", "'y' AS `a.b`", "2L AS id") if extra else df

    return docs
