"""Readers and writers: yearly ride layouts, station weather, reports, splits."""
