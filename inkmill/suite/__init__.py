"""Registered queries."""

from inkmill.suite import ingest, review, rules, shelf  # noqa: F401
from inkmill.suite.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
