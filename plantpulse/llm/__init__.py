"""Operators for preparing training text: scoring, filtering, deduplication, counting, packing, formatting."""
