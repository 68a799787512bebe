"""Sequence analytics on Spark DataFrames."""
