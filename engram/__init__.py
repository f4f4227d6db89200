"""A Spark-native retrieval memory."""

__version__ = "0.1.0"
