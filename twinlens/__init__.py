"""Spark-native matching and deduplication engine."""

__version__ = "0.1.0"
