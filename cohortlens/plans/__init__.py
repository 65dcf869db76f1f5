"""Composite domain operators, one module per case study."""
