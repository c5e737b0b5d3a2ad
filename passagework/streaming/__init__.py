"""Continuous indexing with Structured Streaming."""
