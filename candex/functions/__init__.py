"""Column functions: names, numbers, signatures."""
