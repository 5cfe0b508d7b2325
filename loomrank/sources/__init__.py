"""sources of the ranking engine."""
