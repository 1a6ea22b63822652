"""Relational layout, reading order and text."""
