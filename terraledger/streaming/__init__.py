"""Property-analytics streaming."""
