"""Column expressions: text in, column out, no jobs started."""
