"""Spark-native analytics over byte- and record-level content data."""
