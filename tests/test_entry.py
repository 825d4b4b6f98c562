from __future__ import annotations

import __spark_entry__ as contract
from freightlens.plans import ANALYSES


def test_contract(spark):
    assert set(ANALYSES) <= contract.oracle_sql().keys() <= contract.queries().keys()
    flagship = contract.entry(spark)
    assert flagship.columns == ["risk_classification", "avg_fuel_rate"]
    assert flagship.count() == 3
