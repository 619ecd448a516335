"""Spark-native analytics over ordered event logs and position graphs."""
