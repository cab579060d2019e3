"""Example queries: every operator on the test tables, most with an equivalent SQL text."""

from candex.catalog import aggregates, filters, flagship, lookups, scalars, windows  # isort: skip
from candex.catalog import searches, streams  # after the batch queries whose SQL it shares
from candex.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "filters", "flagship", "lookups", "scalars", "searches", "streams", "windows"]
