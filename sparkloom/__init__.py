"""Sparse-array analytics on Spark DataFrames."""
