"""Operators for preparing training data, each on plain DataFrames.

Nothing else in the library imports this subpackage.
"""
