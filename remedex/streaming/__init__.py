"""Structured Streaming forms of operators that take rows as they land."""
