"""All registered queries."""

from . import entity_queries, quality_queries, record_queries, scan_queries, section_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
