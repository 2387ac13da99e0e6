"""All queries over the reports' operators and their SQL."""

from worklens.plans import flow_queries, ingest_queries, ml_queries, report_queries, scalar_queries, text_skill_queries  # noqa: F401
from worklens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
