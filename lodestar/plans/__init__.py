"""Registered queries."""

from lodestar.plans import added, changes, evidence, places, reviews, rules, runs, snapshots, sources, work  # noqa: F401
from lodestar.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
