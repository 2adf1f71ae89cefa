"""Streaming of the memory engine."""
