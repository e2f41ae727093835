"""Spark-native analytics over city, relationship, text and time-series data."""
