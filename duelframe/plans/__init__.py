"""Whole-table computations composed from the operators."""
