"""Functions of the memory engine."""
