"""Column functions: tokens, predicates, score units."""
