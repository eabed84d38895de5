"""A PySpark-native engine for building and searching libraries of documents."""
