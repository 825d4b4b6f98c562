from __future__ import annotations

import pytest

from freightlens.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows, clash=()):
        schema = "doc_id long, text string" + "".join(f", {c} string" for c in clash)
        return spark.createDataFrame([(*r, *("x" for _ in clash)) for r in rows], schema)

    return make
