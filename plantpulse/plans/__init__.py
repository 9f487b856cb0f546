"""Configured runs: a YAML layer specification and the job that carries it out."""
