"""Structured Streaming forms of the reference's incremental behaviour (survey M01-M07)."""
