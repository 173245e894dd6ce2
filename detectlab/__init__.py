"""Measure sensitive-data detectors on tables and streams with Spark."""

from detectlab.session import get_spark, read_table

__all__ = ["get_spark", "read_table"]
