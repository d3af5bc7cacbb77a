"""Spark-native analytics over binary containers and block-structured data."""
