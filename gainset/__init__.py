"""Spark-native mining of uncertain transactions with signed profits."""
