"""Expressions, aggregates and semirings, as Spark columns."""
