"""Incremental (Structured Streaming) form of the occurrence counts."""
