"""Column expressions: grid cells, clock parts, number parsing, quantiles."""
