"""Registered queries: every operator run over the whole given tables, with SQL twins."""

from halocline.queries import curve_queries, file_queries, model_queries, particle_queries  # noqa: F401
from halocline.queries.registry import oracle_sql, queries, raw_queries

__all__ = ["oracle_sql", "queries", "raw_queries"]
