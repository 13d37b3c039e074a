"""Operators on DataFrames: validation, change data, windows and rules."""
