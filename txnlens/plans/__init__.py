"""Compositions of operators and the registered queries."""

from __future__ import annotations


def all_queries():
    """``(queries, oracle SQL)`` of every query module."""
    from txnlens.plans import catalog, row_queries, run_queries, score_queries, table_queries  # noqa: F401

    return dict(catalog.QUERIES), dict(catalog.ORACLE)
