"""Spark-native text-knowledge and learning analytics."""
