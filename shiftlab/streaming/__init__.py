"""Structured Streaming operators (top-N retrieval, evaluation counts)."""
