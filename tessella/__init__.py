"""Spark-native tiling, annotation and match analytics for imagery-derived vector data."""
