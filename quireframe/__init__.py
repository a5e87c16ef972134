"""Spark-native analytics over laid-out documents."""
