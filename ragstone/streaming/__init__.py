"""Streaming forms of the retrieval operators."""
