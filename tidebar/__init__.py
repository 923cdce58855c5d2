"""Spark-native analytics for market bars and other ordered event data."""
