"""Column expressions: vectors, colour, space-filling curves, quantisation."""
