"""glosspan: a PySpark-native document retrieval and analytics engine."""

__version__ = "0.2.0"
