"""Whole examinations composed of operators, and the registered queries."""
