"""Structured Streaming forms of the live loops."""
