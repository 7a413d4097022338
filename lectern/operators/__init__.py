"""Operators of the readability engine."""
