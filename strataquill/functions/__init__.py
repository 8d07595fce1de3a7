"""Column expressions: text, paths and classification."""
