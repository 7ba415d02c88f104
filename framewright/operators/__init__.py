"""Operators on DataFrames: ordered scans, as-of matching, comparison."""
