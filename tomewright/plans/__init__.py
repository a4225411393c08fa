"""Named queries over the driver's tables, each with an independent SQL statement where SQL can express it."""

from . import bookkeeping_queries, generation_queries, relational_queries, retrieval_queries, store_queries, text_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "bookkeeping_queries", "generation_queries", "relational_queries", "retrieval_queries", "store_queries", "text_queries"]
