"""Property-analytics functions."""
