"""Readers, writers and the field views over the given tables."""
