"""Spark-native evidence analytics: see README.md."""
