"""tidemark: a Spark-native engine for append-only event archives."""

__version__ = "0.1.0"
