"""All queries of the library: by name, the DataFrame query and its SQL twin."""

from __future__ import annotations

from .plans import browse, detail_queries, document_queries, feeds, finding_queries, interval_queries, matching_queries, media_queries, merges, naming_queries, reports, scalar_queries, upkeep_queries
from .plans._registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "browse", "detail_queries", "document_queries", "feeds", "finding_queries", "interval_queries", "matching_queries", "media_queries", "merges", "naming_queries", "reports", "scalar_queries", "upkeep_queries"]
