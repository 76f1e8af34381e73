"""Spark-native retrieval, corpus and evaluation engine."""
