"""The registered queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from . import composed, diffs, graphs, history, joins, lookups, retrieval, scoring, selection, streams, windows  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
