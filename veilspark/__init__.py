"""Spark-native sensitive-data analytics: detection, scoring, masking and reports as DataFrame expressions."""
