"""Column expressions: nulls, clocks, harmonic shapes and scores."""
