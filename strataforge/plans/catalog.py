"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import evaluation_queries, panel_queries, study_queries  # noqa: F401  the modules register their queries
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
