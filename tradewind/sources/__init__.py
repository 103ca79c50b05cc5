"""Schemas, readers, writers and the binding to the star-schema tables."""
