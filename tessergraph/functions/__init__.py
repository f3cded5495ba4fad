"""Column expressions: predicates over elements and relationships, and the search language."""
