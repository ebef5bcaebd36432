"""Whole dataflows and the views that feed them."""
