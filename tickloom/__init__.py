"""Spark-native trade-tick analytics."""
