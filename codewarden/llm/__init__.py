"""Operators for the preparation of training text at scale; nothing else in the package imports them."""
