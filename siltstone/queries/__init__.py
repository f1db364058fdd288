"""Registered queries of the engine: importing the package fills the registry."""

from siltstone.queries import analytics, composites, extract, relational, sources, text
from siltstone.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "composites", "extract", "relational", "sources", "text"]
