"""Column expressions and Arrow functions."""
