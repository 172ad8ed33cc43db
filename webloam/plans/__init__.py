"""Whole chains composed from the operators."""
