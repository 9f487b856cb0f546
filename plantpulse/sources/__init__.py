"""Readers for readings: CSV, run files, processed splits, records and generated data."""
