"""Readers, writers and small literal tables."""
