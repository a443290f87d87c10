"""loomlake: a PySpark-native engine for document knowledge pipelines."""

__version__ = "0.1.0"
