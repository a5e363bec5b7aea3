"""Spanloom: interval algebra, ranking and structured-text analytics on PySpark DataFrames."""
