"""Joins, windows, aggregates and estimators over DataFrames."""
