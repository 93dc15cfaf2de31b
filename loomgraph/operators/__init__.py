"""Graph operators: metrics, traversal, structure, communities, search."""
