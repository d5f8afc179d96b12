"""Spark-native analytics for transport-operations risk."""
