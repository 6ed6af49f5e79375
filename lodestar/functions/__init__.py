"""Column expressions: identity hashes, ranks, rates, text and path scalars."""
