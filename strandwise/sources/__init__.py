"""Readers and writers of sequence files."""
