"""Spark-native point-cloud analytics."""
