"""Sequence analytics on DataFrames."""
