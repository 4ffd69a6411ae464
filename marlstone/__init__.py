"""Spark-native analytics for market data, research decisions and text corpora."""
