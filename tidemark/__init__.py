"""tidemark: a Spark-native engine for numeric time series."""

__version__ = "0.1.0"
