"""Reading statements and writing tables."""
