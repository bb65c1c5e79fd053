"""Column expressions: rates, measures and business rules."""
