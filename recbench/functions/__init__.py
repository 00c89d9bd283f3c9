"""Column expressions: vectors, scalars and text."""
