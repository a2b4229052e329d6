"""Scans and sinks."""

from lattica.sources.tables import TABLES, read_table, read_tables, write_table

__all__ = ["TABLES", "read_table", "read_tables", "write_table"]
