"""Spark-native evaluation analytics: scoring, aggregation, guards and tests over text tables."""

__version__ = "0.1.0"
