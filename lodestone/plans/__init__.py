"""The query registry, filled by importing the query modules."""

from . import data_queries, search_queries, service_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "data_queries", "search_queries", "service_queries", "text_queries"]
