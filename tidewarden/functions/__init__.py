"""Column functions: JSON text, predicates, constraints and scalars."""
