"""statelake: a Spark-native engine for statement (entity, property, value) data."""

__version__ = "0.1.0"
