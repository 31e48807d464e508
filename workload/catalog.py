"""All registered queries."""

from workload import parse_queries, queries, stream_queries
from workload.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "parse_queries", "queries", "stream_queries"]
