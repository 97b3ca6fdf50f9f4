"""Multiview geospatial analytics on Spark DataFrames."""
