"""Spark-native analytics for tables of point events."""
