"""Plans of the readability engine."""
