"""Operators over rated texts and vectors."""
