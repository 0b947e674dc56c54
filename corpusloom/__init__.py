"""Spark-native document analytics, hybrid retrieval and corpus preparation."""
