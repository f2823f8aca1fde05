"""Registered queries: fixtures, Spark plans and their SQL counterparts."""
