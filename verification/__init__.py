"""Checks against an independent engine: inputs derived from the test tables, queries, and their SQL."""
