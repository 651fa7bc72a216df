"""Operators that a training-data pipeline needs, on plain DataFrames.

Nothing else in the library imports this subpackage.
"""
