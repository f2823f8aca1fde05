"""Property-analytics operators."""
