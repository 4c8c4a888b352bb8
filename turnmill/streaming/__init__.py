"""Structured Streaming forms of the window and dedup rules."""
