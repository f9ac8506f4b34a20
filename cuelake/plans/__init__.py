"""Plans of the timed-text engine."""
