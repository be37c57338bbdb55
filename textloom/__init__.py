"""Spark-native text curation and experiment analytics."""
