"""Spark-native analytics for semi-structured laboratory observations."""
