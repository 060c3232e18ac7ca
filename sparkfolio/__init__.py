"""Spark-native analytics over patent-like documents: retrieval, evaluation, guards and corpus preparation."""

__version__ = "0.1.0"
