"""Catalogue analytics on Spark: browse, reports, matching, merges, feeds and intervals."""
