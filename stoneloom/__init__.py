"""A Spark-native engine for text, graph and clustering analytics."""
