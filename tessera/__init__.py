"""Spark-native document intelligence and retrieval analytics."""
