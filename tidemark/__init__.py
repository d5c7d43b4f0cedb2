"""Bitemporal numeric time series on Spark DataFrames."""
