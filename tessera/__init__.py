"""Spark-native spatio-temporal event analytics."""
