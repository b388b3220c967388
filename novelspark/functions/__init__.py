"""Column expressions: vectors, geography, time, keyed randomness."""
