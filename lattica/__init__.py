"""Spark-native analytics over clinical knowledge graphs, texts and labelled samples."""

__version__ = "0.1.0"
