"""A Spark-native engine for hybrid retrieval and evidence-based recommendation."""
