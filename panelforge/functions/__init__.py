"""Column builders: pure expressions, no action, no state."""
