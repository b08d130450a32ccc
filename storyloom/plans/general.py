"""Queries of the general training-data operators (problem 7)."""

from __future__ import annotations

from storyloom.operators.instants import instants_found, normalised_published
from storyloom.sources.tables import read_table

QUERIES = {
    "p7_found": lambda spark, d: instants_found(read_table(spark, d, "articles"), read_table(spark, d, "sources")),
    "p7_normalised": lambda spark, d: normalised_published(read_table(spark, d, "articles"), read_table(spark, d, "sources")),
}

SQL: dict[str, str] = {}
