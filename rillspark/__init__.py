"""Spark-native urban-flood analytics."""
