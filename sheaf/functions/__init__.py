"""Column-expression builders (parsing, routing, formatting)."""
