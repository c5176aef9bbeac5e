"""Millrace: a PySpark-native ingestion, data-quality and analytical query engine."""

__version__ = "0.1.0"
