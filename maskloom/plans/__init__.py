"""Metrics and the registry of queries."""
