"""All registered queries; importing a module registers what it holds."""

from truegauge.plans import check_queries, report_queries, source_queries, star_queries  # noqa: F401
from truegauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
