"""Relational operators: DataFrames in, DataFrames out, nothing executed here."""
