"""All registered queries."""

from listenlake.checks import catalog_checks, operator_checks, report_checks, source_checks  # noqa: F401
from listenlake.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
