"""Operators for large text corpora: each takes and returns DataFrames."""
