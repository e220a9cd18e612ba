"""Spark-native analytics over company filings: detection, scoring, classification, indices and roll-ups."""
