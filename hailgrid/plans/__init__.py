"""Composite workflows and the query catalogue with its oracle SQL."""
