"""Spark-native analytics over assistant answers, and training-data operators."""
