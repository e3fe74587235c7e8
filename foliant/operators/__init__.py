"""Relational operators over records."""
