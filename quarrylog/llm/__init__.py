"""Operators for preparing training data: one module per operator, all over DataFrames.

Nothing else in the library imports this subpackage.
"""
