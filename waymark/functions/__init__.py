"""Column expressions without any Python per-row work."""
