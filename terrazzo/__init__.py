"""Exact planar geometry and conformance analytics on Spark DataFrames."""
