"""Spark-native analytics over coordinate-indexed counts."""
