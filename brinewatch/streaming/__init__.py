"""Structured Streaming jobs and the runner that drains a stream into a table."""

from brinewatch.streaming.jobs import (
    deduplicated,
    enriched,
    fabric_stream,
    kappa_stream,
    run_fabric,
    run_kappa,
    run_speed,
    speed_stream,
    tumbling,
    validated,
)
from brinewatch.streaming.keyed import KeyedTable, UpsertLog
from brinewatch.streaming.run import drain, drain_insert_ignore, drain_split, drain_upserts
from brinewatch.streaming.served import ServedStream

__all__ = [
    "KeyedTable", "ServedStream", "UpsertLog", "deduplicated", "drain", "drain_insert_ignore", "drain_split",
    "drain_upserts", "enriched", "fabric_stream", "kappa_stream", "run_fabric", "run_kappa", "run_speed",
    "speed_stream", "tumbling", "validated",
]
