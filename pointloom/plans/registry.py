"""The registered queries of the shape operators and their SQL."""

from __future__ import annotations

from . import mesh_queries, point_queries

QUERIES = point_queries.QUERIES | mesh_queries.QUERIES
ORACLE_SQL = point_queries.SQL | mesh_queries.SQL
FLAGSHIP = "feature_vector36"
