"""Presence and occupancy analytics on Spark DataFrames."""
