"""Composite pipelines and the catalogue of registered queries."""
