"""Outcome analytics as DataFrame operators: clean, mask, check, model, mine and watch tables and streams."""
