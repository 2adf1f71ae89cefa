"""Operators of the memory engine."""
