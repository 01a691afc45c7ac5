"""Layered-graph motif analytics on PySpark DataFrames."""
