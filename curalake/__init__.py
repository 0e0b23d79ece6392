"""Spark-native curation and reconciliation of evidence tables."""
