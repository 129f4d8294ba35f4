"""Structured Streaming forms and stateful rules."""
