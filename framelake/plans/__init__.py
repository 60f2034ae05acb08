"""Whole reads and the registered queries."""
