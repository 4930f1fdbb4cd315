"""Structured Streaming forms of the market operators."""
