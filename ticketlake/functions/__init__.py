"""Column-to-column functions; no Python runs per row."""
