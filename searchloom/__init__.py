"""A Spark-native engine for web-search analytics."""

__version__ = "0.1.0"
