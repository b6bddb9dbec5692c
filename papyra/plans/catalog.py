"""All queries of the core with the SQL each is checked against."""

from __future__ import annotations

from papyra.plans import chunk_queries, question_queries, record_queries, retrieval_queries, source_queries, text_queries  # noqa: F401  (they register themselves)
from papyra.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
