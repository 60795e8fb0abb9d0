"""Retrieval workflows over many queries at once, and analytics of their traces, as Spark DataFrames."""
