"""The registered queries against their DuckDB statements, and the registration itself."""

from __future__ import annotations

import pytest

import __spark_entry__
from freightlens.llm.oracle import ORACLE
from freightlens.llm.queries import QUERIES
from oracle_compare import duck, differences


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", ORACLE)
def test_matches_oracle(spark, name, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), duck(sf_dir).sql(ORACLE[name])) == []


def test_each_operator_has_one_query():
    numbers = [name.split("_")[0] for name in QUERIES]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())
