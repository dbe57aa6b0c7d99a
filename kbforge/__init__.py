"""Spark-native document retrieval, knowledge-base and log analytics engine."""
