"""Operators for training text: source files, leaked evaluation items, mixing, truncation."""
