"""File sources and table sinks."""

from palletwise.sources import files, landing, sinks, workbook

__all__ = ["files", "landing", "sinks", "workbook"]
