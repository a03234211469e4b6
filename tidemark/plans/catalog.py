"""All queries of the engine's own operators, with equivalent SQL."""

from __future__ import annotations

from tidemark.plans import clocks, contents, feeds, layouts, merging, owners, pushes, querying, replicas, rollups, stores, streams, unplaced  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
