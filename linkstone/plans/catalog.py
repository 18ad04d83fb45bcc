"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from .er_queries import QUERIES
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
