"""Column expressions on coordinates, blocks and complex numbers."""
