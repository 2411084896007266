"""Spark-native engine for tagged gauges, counts and ratios."""
