"""Streaming document clustering on Spark."""
