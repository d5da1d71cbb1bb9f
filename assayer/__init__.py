"""Assayer: a Spark-native engine for rule-driven scoring, record resolution and evaluation analytics."""
