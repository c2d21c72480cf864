"""Every registered query of the log operators, next to the DuckDB SQL it is held against."""

from . import decision_queries, group_queries, integrity_queries, metadata_queries, metric_queries, order_queries, record_queries, scan_queries, segment_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decision_queries", "group_queries", "integrity_queries", "metadata_queries", "metric_queries", "order_queries", "record_queries", "scan_queries", "segment_queries"]
