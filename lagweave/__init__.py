"""Spark-native analysis and coding of regularly sampled signals."""
