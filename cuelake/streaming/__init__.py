"""Streaming of the timed-text engine."""
