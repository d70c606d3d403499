"""litquarry: a PySpark-native engine for literature surveillance and text-corpus preparation."""

__version__ = "0.1.0"
