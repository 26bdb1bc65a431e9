"""Operators: each takes and gives a `DataFrame`."""
