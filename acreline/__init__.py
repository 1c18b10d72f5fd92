"""Spark-native analytics for property listings."""
