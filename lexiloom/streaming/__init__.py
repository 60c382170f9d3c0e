"""Additions to indexes and statistics from streams."""
