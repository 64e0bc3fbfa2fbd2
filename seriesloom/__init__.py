"""Measurement-series analytics as Spark DataFrame operations."""
