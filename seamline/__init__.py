"""A Spark-native engine for code search and retrieval analytics."""
