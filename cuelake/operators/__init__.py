"""Operators of the timed-text engine."""
