"""Batch operators: each one maps DataFrames to DataFrames."""
