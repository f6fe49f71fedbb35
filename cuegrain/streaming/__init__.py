"""streaming of the timed-text engine."""
