"""Predictive-maintenance analytics for industrial sensor series, on Spark DataFrames."""
