"""DataFrame -> DataFrame operators."""

from palletwise.operators import catalogue, clean, compare, rollups, tables

__all__ = ["catalogue", "clean", "compare", "rollups", "tables"]
