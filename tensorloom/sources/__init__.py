"""Tensors of the given tables."""
