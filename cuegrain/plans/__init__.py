"""Registered plans: one for each operator and composite pipeline."""
