"""The library's queries and their SQL."""

from __future__ import annotations

from tracklens.plans import aggregate_queries, base, join_queries, scalar_queries, similarity_queries, source_queries  # noqa: F401

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL


def entry(spark, sf_dir):
    return similarity_queries.flagship(spark, sf_dir)
