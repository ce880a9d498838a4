"""Column expressions: geometry, vectors, strings, pixels."""
