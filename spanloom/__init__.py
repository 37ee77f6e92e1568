"""Retrieval evaluation over document corpora as Spark DataFrames."""
