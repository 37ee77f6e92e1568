"""Column functions over texts and vectors, and model providers."""
