"""Column expressions: calendar, cyclical, interaction features and predicates."""
