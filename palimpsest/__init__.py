"""A PySpark-native engine for verbatim-memory retrieval and corpus analytics."""

__version__ = "0.2.0"
