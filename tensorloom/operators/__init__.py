"""Contractions, algebra, reductions, factorizations, networks and constrained tensors."""
