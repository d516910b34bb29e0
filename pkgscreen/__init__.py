"""Packaged-goods label screening and document retrieval on Spark DataFrames."""
