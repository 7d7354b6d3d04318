"""Spark-native extraction, evaluation and corpus-preparation engine."""
