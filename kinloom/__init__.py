"""Embedding-based entity grouping and journal analytics on Spark DataFrames."""
