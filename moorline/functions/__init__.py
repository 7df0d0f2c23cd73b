"""Scalar functions as Column expressions: transforms, names, similarity, geography."""
