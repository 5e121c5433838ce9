"""Threshold-exceedance analytics on Spark DataFrames."""
