"""Scoped-memory analytics and corpus preparation on PySpark."""
