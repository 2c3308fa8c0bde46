"""Spark-native geospatial production analytics."""
