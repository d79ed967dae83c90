"""Spark jobs for sparse matrices held as DataFrames."""
