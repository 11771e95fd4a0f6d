"""Spark-native profiling, compatibility and data-quality engine."""
