from freightlens.oracle.duckdb_sql import ORACLE

__all__ = ["ORACLE"]
