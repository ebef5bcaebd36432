"""Incremental forms of the batch operators."""
