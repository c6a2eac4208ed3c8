"""Operators that a large training-data pipeline needs, on Spark DataFrames.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
