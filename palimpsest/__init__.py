"""Versioned, multi-dimensional key-value analytics as Spark plans."""
