"""Scalar functions: integer semantics, codecs, units."""
