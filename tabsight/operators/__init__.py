"""DataFrame operators, one module per step."""
