"""Geoloom: spatial analytics on Spark DataFrames."""
