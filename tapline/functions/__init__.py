"""Column functions (no Python UDFs)."""
