"""All queries of the library's own operators and the SQL that each must agree with."""

from __future__ import annotations

from quarrysift.plans import code_queries, record_queries, relational_queries, source_queries, text_queries  # noqa: F401  they register their queries
from quarrysift.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
