"""Structured Streaming variants of the log operators."""
