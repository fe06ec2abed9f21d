"""Spark-native table operators for class labels, zones, pixels, vectors and predictions."""

__version__ = "0.1.0"
