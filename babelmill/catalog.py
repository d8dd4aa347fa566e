"""Every query of the engine by name, with the SQL it is checked against."""

from __future__ import annotations

from babelmill.plans import block_queries, dialogue_queries, file_queries, more_queries, rule_queries  # noqa: F401  (register their queries)
from babelmill.plans.queries import ORACLES, QUERIES

FLAGSHIP = "segments"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
