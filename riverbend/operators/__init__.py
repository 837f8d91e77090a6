"""Operators on DataFrames: mapping, value lookup, keyset scans, change events, conflict handling."""
