"""Scans and sinks of records."""
