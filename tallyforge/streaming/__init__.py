"""Structured Streaming forms of the windowed, first-seen and idempotent operators."""
