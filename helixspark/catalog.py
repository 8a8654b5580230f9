"""Registered queries of the sequence operators, and their SQL."""

from __future__ import annotations

from helixspark.plans import kernel_queries, path_queries, registry, strand_queries, table_queries  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark, sf_dir: str):
    return queries()["evaluate"](spark, sf_dir)
