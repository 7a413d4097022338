"""Streaming of the readability engine."""
