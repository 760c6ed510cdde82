"""Lodestone: a Spark-native retrieval and document analytics engine."""
