"""Structured Streaming forms of operators that work record by record."""
