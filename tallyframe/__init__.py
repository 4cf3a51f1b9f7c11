"""Spark-native reconciliation of versions of technical documents."""
