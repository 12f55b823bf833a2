"""Registered queries: each applies one operator to whole tables; most have equal DuckDB SQL beside them."""

from __future__ import annotations


def _modules():
    from . import acts, corpus, extraction, files, lookups, numbers, replies, skills, threads

    return (acts, extraction, skills, numbers, lookups, corpus, threads, files, replies)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from ..views import with_views

    return {k: with_views(v) for m in _modules() for k, v in m.ORACLES.items()}
