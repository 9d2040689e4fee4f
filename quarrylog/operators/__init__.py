"""Evaluation of rule bodies and of strata over DataFrames."""
