"""Spark jobs for gridded fire-susceptibility data: DataFrames in, DataFrames out."""
