"""Sources of the readability engine."""
