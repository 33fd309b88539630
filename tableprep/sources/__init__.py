"""Reading and writing tables."""

from tableprep.sources.tables import read_table, stage_table, staging, write_table

__all__ = ["read_table", "stage_table", "staging", "write_table"]
