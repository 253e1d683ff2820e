"""Operators: DataFrames in, DataFrames out, keyed by city and tile."""
