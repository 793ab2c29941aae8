"""Structured Streaming forms of the assessment."""
