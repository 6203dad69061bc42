"""Quarry: a Spark-native engine for document retrieval."""
