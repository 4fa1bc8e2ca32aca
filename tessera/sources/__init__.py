"""Tables and logs as DataFrames with explicit schemas."""

from .exports import content_key, write_export
from .readers import events, read_door_log, read_table

__all__ = ["content_key", "events", "read_door_log", "read_table", "write_export"]
