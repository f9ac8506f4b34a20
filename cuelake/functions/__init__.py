"""Functions of the timed-text engine."""
