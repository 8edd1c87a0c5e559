"""Operators on array variables in long form: one column for each index, and ``value``."""
