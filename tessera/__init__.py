"""tessera: a Spark-native engine for storing, searching and analysing text memory."""

__version__ = "0.1.0"
