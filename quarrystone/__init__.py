"""Spark-native analytics over media-catalogue, workflow and document tables."""
