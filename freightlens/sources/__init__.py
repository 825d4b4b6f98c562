from freightlens.sources.hot_keys import hot_keys, is_broadcast, spread_join
from freightlens.sources.scratch import (
    StoredTables,
    clear_stored,
    owned_tables,
    scratch_root,
    stored,
)
from freightlens.sources.shipments import (
    SHIPMENT_SCHEMA,
    load_shipments,
    read_fact,
    register,
)

__all__ = [
    "SHIPMENT_SCHEMA",
    "StoredTables",
    "clear_stored",
    "hot_keys",
    "is_broadcast",
    "load_shipments",
    "owned_tables",
    "read_fact",
    "register",
    "scratch_root",
    "spread_join",
    "stored",
]
