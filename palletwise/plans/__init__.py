"""Composite jobs, the test-table views and the registered queries."""

from palletwise.plans import jobs, views

__all__ = ["jobs", "views"]
