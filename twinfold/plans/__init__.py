"""Whole pipelines and the registered queries."""
