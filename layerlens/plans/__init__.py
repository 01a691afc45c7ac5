"""Composite analyses: several operators, several result tables."""
