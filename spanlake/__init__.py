"""Interval-event analytics on Spark DataFrames."""
