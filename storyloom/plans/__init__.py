"""Queries by name, and the SQL that gives the same rows."""
