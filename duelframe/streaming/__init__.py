"""Structured Streaming forms of the metric log."""
