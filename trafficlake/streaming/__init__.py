"""Structured Streaming forms of the traffic operators."""
