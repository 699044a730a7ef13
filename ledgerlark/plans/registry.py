"""All queries of the library, and their SQL."""

from __future__ import annotations

from . import change_queries, landed_queries, place_queries, queue_queries, series_queries, service_queries, text_queries  # noqa: F401  they register themselves
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
