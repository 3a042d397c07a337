"""Registered queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations


def _load() -> None:
    # Importing the modules registers their queries.
    from pallium.plans import answer_queries, pii_queries, span_queries, store_queries, text_queries  # noqa: F401


def all_queries():
    from pallium.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from pallium.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
