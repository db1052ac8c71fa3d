"""Spark-native engine for boosted-tree analytics over tabular data."""

__version__ = "0.1.0"
