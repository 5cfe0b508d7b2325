"""streaming of the ranking engine."""
