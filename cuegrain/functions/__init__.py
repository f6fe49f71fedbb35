"""functions of the timed-text engine."""
