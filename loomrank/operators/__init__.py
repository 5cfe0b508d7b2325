"""operators of the ranking engine."""
