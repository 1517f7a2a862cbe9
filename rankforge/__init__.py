"""Ranking audits and training-data preparation on Spark."""
