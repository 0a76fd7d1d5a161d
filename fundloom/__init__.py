"""Spark-native funding, entity and text analytics."""
