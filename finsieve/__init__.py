"""Spark-native extraction and checking of financial-statement line items."""
