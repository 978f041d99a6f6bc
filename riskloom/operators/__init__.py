"""Operators: one module per family, each a function from DataFrame to DataFrame."""
