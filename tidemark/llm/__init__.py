"""Training-data operators: one module per operator, plus the thin queries of their contracts."""
