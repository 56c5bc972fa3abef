"""Column to Column functions; no Python per row."""
