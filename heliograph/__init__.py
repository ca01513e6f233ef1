"""Spark-first analytics for irregular sensor series, solar physics and training-data corpora."""
