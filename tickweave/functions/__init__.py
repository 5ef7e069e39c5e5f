"""Column expressions for text."""
