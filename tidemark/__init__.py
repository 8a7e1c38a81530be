"""Temporal-stream and periodic-signal analytics on Spark DataFrames."""
