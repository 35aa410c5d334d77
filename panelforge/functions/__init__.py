"""Column expressions: months, numbers, text, random numbers."""
