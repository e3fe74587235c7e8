"""Whole runs, and the catalogue of queries with their SQL."""
