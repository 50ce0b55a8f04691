"""Column expressions: numbers, text, vectors and predicates."""
