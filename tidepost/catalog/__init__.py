"""Registered queries: each operator run on the shared test tables, with its SQL."""

from tidepost.catalog.registry import ORACLES, QUERIES
from tidepost.catalog import jobs, posts, state, streams, topic_queries, work  # noqa: F401  (registers)
from tidepost.catalog import stored  # noqa: F401  (registers; uses the SQL of the others)

__all__ = ["ORACLES", "QUERIES"]
