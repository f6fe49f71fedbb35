"""sources of the timed-text engine."""
