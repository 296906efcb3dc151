"""Operators that prepare training text: one module for each, on whole tables."""
