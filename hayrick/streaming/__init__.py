"""Freshness of an index as streams."""
