"""Registered queries of the engine's own operators, with the SQL they are held against."""

from . import evaluation, memory, projections, retrieval, streams

QUERIES = retrieval.QUERIES | memory.QUERIES | evaluation.QUERIES | streams.QUERIES | projections.QUERIES
ORACLE_SQL = retrieval.SQL | memory.SQL | evaluation.SQL | streams.SQL | projections.SQL
