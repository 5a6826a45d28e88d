"""Retrieval, text-mining and conversation analytics on Spark."""
