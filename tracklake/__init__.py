"""Spark-native analytics for tracked objects, run-length label volumes and training text."""
