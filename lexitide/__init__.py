"""Spark-native analytics for large historical text collections."""
