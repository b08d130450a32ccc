"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a data directory; the scan stays lazy and prunable."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
