"""Operators over training text: packing, evaluation leakage, shared spans."""
