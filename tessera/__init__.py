"""Spark-native repository analytics and retrieval."""
