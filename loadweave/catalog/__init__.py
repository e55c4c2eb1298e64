"""Registered queries: each a Spark job over the given tables, most with an equivalent SQL text."""

from loadweave.catalog import experiment, ingest, scoring, series  # noqa: F401  (fill the registry)
from loadweave.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
