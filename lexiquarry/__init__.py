"""A PySpark-native full-text indexing and search engine."""
