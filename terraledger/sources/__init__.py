"""Property-analytics sources."""
