"""A Spark-native engine for ranked, time-aware retrieval over typed text records."""
