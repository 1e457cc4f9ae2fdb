"""Structured Streaming jobs for reader events."""
