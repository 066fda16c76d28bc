"""Samples of fragment lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """One number a line: a column len."""
    return spark.read.schema("len int").csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
