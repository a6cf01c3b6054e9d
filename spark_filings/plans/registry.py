"""The registered queries: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from . import asking, checking, claiming, retrieval, scoring, sourcing, verifying

MODULES = [retrieval, sourcing, checking, claiming, scoring, asking, verifying]

FLAGSHIP = retrieval.top_passages


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
