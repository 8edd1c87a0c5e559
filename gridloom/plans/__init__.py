"""Schemas of datasets, error codes, and coupling plans."""
