"""Column functions: random numbers and logical types."""
