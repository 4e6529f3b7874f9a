"""Claim verification and training-data jobs as Spark DataFrames."""
