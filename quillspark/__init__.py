"""A PySpark-native engine for a small SQL dialect with spatial, text and vector search."""
