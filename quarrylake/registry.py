"""All queries by name, and the same in SQL."""

from __future__ import annotations

from .plans import chat, library, upkeep  # noqa: F401  (they register their queries)
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
