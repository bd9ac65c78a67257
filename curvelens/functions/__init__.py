"""Column expressions: parsing, metric names, windows."""
