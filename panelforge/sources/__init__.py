"""Parquet scans with declared columns."""

from panelforge.sources.tables import table

__all__ = ["table"]
