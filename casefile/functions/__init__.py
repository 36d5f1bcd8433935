"""Column functions: text rules and scale-safe ordered computations."""
