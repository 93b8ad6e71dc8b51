"""Column expressions: interval statistics, losses, scalar helpers, hash-based randomness."""
