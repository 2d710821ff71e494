"""Spark-native engine for encoded, indexed, column-oriented data."""
