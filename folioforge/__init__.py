"""Spark-native analytics over structured documents, usage events and review tables."""

__version__ = "0.1.0"
