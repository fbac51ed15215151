"""Sequence clustering, search and comparison on Spark DataFrames."""
