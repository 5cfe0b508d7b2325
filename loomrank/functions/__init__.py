"""functions of the ranking engine."""
