"""Relational operators over identifiers and texts."""
