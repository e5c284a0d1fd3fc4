"""Spark analytics for gridded climate fields."""
