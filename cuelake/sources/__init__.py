"""Sources of the timed-text engine."""
