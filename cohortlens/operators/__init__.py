"""Reusable DataFrame operators (aggregation, dedup, shares, statistics)."""
