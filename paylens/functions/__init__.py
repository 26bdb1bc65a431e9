"""Column functions: each takes and gives a `Column`."""
