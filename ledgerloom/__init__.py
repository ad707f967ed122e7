"""Spark-native analytics over transfer graphs."""
