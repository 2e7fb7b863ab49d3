"""Relational operators and versioned tables."""
