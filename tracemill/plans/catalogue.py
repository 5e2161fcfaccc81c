"""The queries over the test tables and their SQL."""

from tracemill.plans import card_queries, compare_queries, coverage_queries, grading_queries, log_queries, mining_queries, parse_queries, scoring_queries, text_queries, view_queries  # noqa: F401
from tracemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
