"""Spark-native analytics over private knowledge bases."""
