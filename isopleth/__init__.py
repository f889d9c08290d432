"""Gridded climate and time-series analytics on Spark DataFrames."""
