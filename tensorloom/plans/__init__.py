"""Order of multi-way products."""
