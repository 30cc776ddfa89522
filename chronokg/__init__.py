"""A PySpark-native engine for ordered text collections, their graphs and retrieval."""
