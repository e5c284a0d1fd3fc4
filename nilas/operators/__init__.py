"""Operators on gridded fields: DataFrames in, DataFrames out."""
