"""Operators that prepare text corpora. Nothing else in the library imports this package."""
