"""Spark-native analytics for building, auditing and scoring change-review datasets."""
