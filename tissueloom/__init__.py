"""Spatial and single-cell analytics on Spark DataFrames."""
