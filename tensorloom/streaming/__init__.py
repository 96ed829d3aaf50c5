"""Incremental contractions over streams."""
