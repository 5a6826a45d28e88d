"""Registered queries."""

from . import reply_queries, retrieval_queries, rule_queries, store_queries, stream_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
