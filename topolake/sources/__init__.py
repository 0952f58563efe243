"""Readers, writers and built-in graph fixtures."""
