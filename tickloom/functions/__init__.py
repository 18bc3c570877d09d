"""Column expressions and series primitives."""
