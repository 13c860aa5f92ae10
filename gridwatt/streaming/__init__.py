"""Structured Streaming forms of the incremental batch operators."""
