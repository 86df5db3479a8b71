"""Spark-native regional evidence analytics."""
