"""plans of the ranking engine."""
