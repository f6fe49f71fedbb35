"""Timed-text corpus analytics as plain functions from DataFrame to DataFrame."""
