"""Column expressions (all JVM-side, no UDFs)."""

from meterwise.functions.ids import uuid5_oid, canonical_uuid, uuid_is_valid
from meterwise.functions.text import go_trim, storage_node_id, excerpt
from meterwise.functions.time import minute_start, day_start, month_start, rfc3339_seconds, as_ntz
from meterwise.functions.prefix import chunked_running, chunked_lag

__all__ = [
    "uuid5_oid", "canonical_uuid", "uuid_is_valid",
    "go_trim", "storage_node_id", "excerpt",
    "minute_start", "day_start", "month_start", "rfc3339_seconds", "as_ntz",
    "chunked_running", "chunked_lag",
]
