"""operators of the timed-text engine."""
