"""Column expressions: scalars and arrays."""
