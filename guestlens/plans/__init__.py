"""Composite queries chained from the operators."""
