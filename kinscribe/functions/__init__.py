"""Scalar functions as Column builders; see strings, names, numbers and collections."""
