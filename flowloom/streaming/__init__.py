"""Structured Streaming jobs over packet streams."""
