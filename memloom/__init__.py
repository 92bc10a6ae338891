"""memloom: a Spark-native engine for text memory, retrieval and corpus preparation."""

__version__ = "0.1.0"
