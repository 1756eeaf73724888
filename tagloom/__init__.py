"""Spark-native context catalog, search, placement analytics and feature engine."""

__version__ = "0.1.0"
