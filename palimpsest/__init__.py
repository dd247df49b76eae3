"""Spark-native analytics for retrieval over noisy text."""
