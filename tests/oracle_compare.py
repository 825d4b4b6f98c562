"""Run a query in Spark and its oracle in DuckDB and compare them as bags of rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

from freightlens.oracle import ORACLE
from freightlens.plans import run

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences of an analysis from its statement; empty when equal."""
    return differences(run(name, spark, sf_dir), con.sql(ORACLE[name]))


def differences(got, want) -> list[str]:
    """Differences in columns, types and rows; empty when equal."""
    problems = []
    got_types = dict(got.dtypes)
    want_types = {c: TYPES.get(str(t), str(t)) for c, t in zip(want.columns, want.types)}
    if got_types != want_types:
        problems.append(f"schema {got_types} != {want_types}")
    order = sorted(want.columns)
    left = Counter(tuple(row) for row in got.select(*order).collect())
    right = Counter(want.select(*(f'"{c}"' for c in order)).fetchall())
    if left != right:
        problems.append(
            f"rows {sum(left.values())} vs {sum(right.values())}; only Spark "
            f"{list((left - right).items())[:3]}; only DuckDB {list((right - left).items())[:3]}"
        )
    return problems
