"""Streaming-retrieval analytics on Spark."""
