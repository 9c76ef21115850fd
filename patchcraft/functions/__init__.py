"""Column expressions (built-ins only)."""
