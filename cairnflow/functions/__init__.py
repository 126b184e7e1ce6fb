"""Column functions: text, weights, vectors, geometry."""
