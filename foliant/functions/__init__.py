"""Column expressions: text normalisation, parsing, similarity, JSON values."""
