"""Column-level expressions (no Python UDFs)."""
