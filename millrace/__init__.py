"""Spark-native feature engineering, evaluation and dataset operators."""
