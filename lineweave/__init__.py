"""Provenance-aware text search and token-budgeted context selection on Spark."""

__version__ = "0.1.0"
