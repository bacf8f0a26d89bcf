"""Whole jobs, and the queries over the given tables."""
