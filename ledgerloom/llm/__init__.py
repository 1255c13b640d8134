"""Operators on training text: packing, leakage of evaluation texts, splitting. Nothing else in the library imports this."""
