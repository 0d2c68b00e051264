"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from lexitide.plans import q_arcs, q_labels, q_models, q_more, q_reports, q_scoring, q_stores, q_tables  # noqa: F401  they register their queries
from lexitide.plans.catalog import ORACLE_SQL, QUERIES

FLAGSHIP = "score_weighted"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
