"""Viewpoints, settings, the all-dates history and its files."""
