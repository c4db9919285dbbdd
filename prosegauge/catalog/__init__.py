"""The registered queries, their check SQL and the seeded corpus."""

from prosegauge.catalog import event_queries, page_queries, report_queries, text_queries  # noqa: F401
from prosegauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
